"""Mixed timestamp formats and zones to one instant.

``readings`` lists every way a value can be read as an array of (format, utc_ms, cost),
entirely in SQL expressions. ``choose`` picks one reading per value by Viterbi over the
record order of each source: it pays each reading's own cost, a penalty for changing the
format from one record to the next and one for going back in time. Every valid reading takes
part. What the stated conventions fix (month first with slashes, day first with dots) is a cost
no penalty outweighs; what they leave open (which of its zones an abbreviation means) costs
about as much as a switch or a jump, so that the neighbours decide it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.text import let
from stackroom.operators.thesaurus import SPACE
from stackroom.session import cut

#: Cost of a reading that a stated convention rules out. More than two switches and two jumps.
AGAINST = 1000.0
SWITCH, JUMP = 1.0, 2.0

# Zone abbreviations in common use with their offsets in minutes; where one
# abbreviation has several uses the first is the usual one.
ABBREVIATIONS = {
    "Z": (0,), "UTC": (0,), "GMT": (0,), "UT": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360), "CET": (60,), "CEST": (120,), "MEZ": (60,), "MESZ": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "MSD": (240,), "SAMT": (240,), "YEKT": (300,), "OMST": (360,), "NOVT": (420,), "KRAT": (420,), "IRKT": (480,),
    "YAKT": (540,), "VLAT": (600,), "IST": (330, 60, 120), "PKT": (300,), "NPT": (345,), "JST": (540,), "KST": (540,), "HKT": (480,), "SGT": (480,),
    "AWST": (480,), "ACST": (570,), "ACDT": (630,), "AEST": (600,), "AEDT": (660,), "NZST": (720,), "NZDT": (780,), "EST": (-300, 600), "EDT": (-240,),
    "CST": (-360, 480), "CDT": (-300,), "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
    "AST": (-240, 180), "ADT": (-180,), "NST": (-210,), "NDT": (-150,), "BRT": (-180,), "ART": (-180,), "SAST": (120,), "EAT": (180,), "WAT": (60,), "CAT": (120,),
}
# The first letters by which month names of both languages are told apart.
MONTHS = (
    ("jan", "янв"), ("feb", "фев"), ("mar", "мар"), ("apr", "апр"), ("may", "май", "мая"), ("jun", "июн"),
    ("jul", "июл"), ("aug", "авг"), ("sep", "сен"), ("oct", "окт"), ("nov", "ноя"), ("dec", "дек"),
)

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*((?:UTC|GMT|UT)?\s*[+-]\d{1,2}(?::?\d{2})?(?:\s*\[[\w/+-]+\])?|[A-Z]{1,5}|[A-Za-z]+(?:/[A-Za-z_+-]+\d*)+)?"
_NAME = r"([A-Za-zА-Яа-яЁё]{3,})\.?"
#: (format, pattern, replacement); the replacement lists year|month|day|hour|minute|second|fraction|half|zone.
SHAPES = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt\s,]\s*{_TIME}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:\s*г\.)?[\s,]\s*(?:в\s+)?{_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("dots_md", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:\s*г\.)?[\s,]\s*(?:в\s+)?{_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[\s,]\s*{_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("slashes_dm", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[\s,]\s*{_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("ctime", rf"^(?:{_NAME},?\s+){_NAME}\s+(\d{{1,2}}),?\s+{_TIME}\s+(\d{{4}}){_ZONE}$", "$9|$2|$3|$4|$5|$6|$7|$8|$10"),
    ("day_name", rf"^(?:[A-Za-zА-Яа-яЁё]{{2,}}\.?,?\s+)?(\d{{1,2}})[\s-]+{_NAME}[\s,-]+(\d{{4}})(?:\s*(?:года|г\.?))?(?:[\s,]+(?:в\s+)?{_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("name_day", rf"^(?:[A-Za-zА-Яа-яЁё]{{2,}}\.?,\s+)?{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:[\s,]+(?:at\s+)?{_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("repr", r"^datetime\.(?:date|datetime)\((\d{4}),\s*(\d{1,2}),\s*(\d{1,2})(?:,\s*(\d{1,2})(?:,\s*(\d{1,2})(?:,\s*(\d{1,2})(?:,\s*(\d{1,6}))?)?)?)?\)$", "$1|$2|$3|$4|$5|$6|u$7||"),
)


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,9}$"), c).cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, in integer arithmetic that cannot fail."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((F.pmod(m + 9, F.lit(12)) * 153 + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_ids(spark: SparkSession) -> list[str]:
    """The zone names Java knows; others are taken for no zone."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _local(ms: Column, zone: Column) -> Column:
    """UTC ms of local ms in a zone: the first of two, and what was skipped by the offset before."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), zone))


def _offset_ms(z: Column) -> Column:
    """Milliseconds of a leading [UTC|GMT]+h[h][:mm] offset, or null."""
    p = r"^(?:UTC|GMT|UT)?\s*([+-])(\d{1,2}):?(\d{2})?"
    h, mi = _int(F.regexp_extract(z, p, 2)), F.coalesce(_int(F.regexp_extract(z, p, 3)), F.lit(0))
    v = (h * 60 + mi) * F.when(F.regexp_extract(z, p, 1) == "-", -60000).otherwise(60000)
    return F.when(z.rlike(p) & (h <= 18) & (mi < 60), v).cast("long")


def _numbers(parts: Column) -> Column:
    """format|year|month|day|hour|minute|second|fraction|half|zone as numbers."""
    at = lambda i: F.element_at(parts, i + 1)
    prefix = F.substring(F.lower(at(2)), 1, 3)
    names = F.create_map(*[x for i, k in enumerate(MONTHS) for n in k for x in (F.lit(n), F.lit(i + 1))])
    h0 = F.coalesce(_int(at(4)), F.lit(0))
    half = F.lower(at(8))
    frac = at(7)
    return F.struct(
        at(0 + 0).alias("fmt"), _int(at(1)).alias("y"), F.coalesce(_int(at(2)), names[prefix]).alias("m"), _int(at(3)).alias("d"),
        F.when(half == "", h0).when((h0 < 1) | (h0 > 12), F.lit(99)).otherwise(h0 % 12 + F.when(half == "p", 12).otherwise(0)).alias("h"),
        F.coalesce(_int(at(5)), F.lit(0)).alias("mi"), F.coalesce(_int(at(6)), F.lit(0)).alias("s"),
        # a repr counts microseconds (marked u), every other format writes decimal digits
        F.when(frac.startswith("u"), F.floor(F.coalesce(_int(F.substring(frac, 2, 9)), F.lit(0)) / 1000))
        .otherwise(F.coalesce(_int(F.rpad(F.substring(frac, 1, 3), 3, "0")), F.lit(0))).cast("long").alias("ms"),
        F.trim(at(9)).alias("z"),
    )


def _local_ms(t: Column) -> Column:
    ok = t["m"].between(1, 12) & (t["d"] >= 1) & (t["d"] <= _month_days(t["y"], t["m"])) & (t["y"] >= 1) & (t["h"] < 24) & (t["mi"] < 60) & (t["s"] < 60)
    ms = _days(t["y"], t["m"], t["d"]) * 86400000 + t["h"] * 3600000 + t["mi"] * 60000 + t["s"] * 1000 + t["ms"]
    cost = F.when(t["fmt"].isin("dots_md", "slashes_dm"), F.lit(AGAINST)).otherwise(F.lit(0.0))
    return F.struct(t["fmt"].alias("fmt"), F.when(ok, ms.cast("long")).alias("ms"), t["z"].alias("z"), _offset_ms(t["z"]).alias("off"), cost.alias("cost"))


def _instants(t: Column, own: Column, known: list[str]) -> Column:
    one = lambda x: F.array(F.struct(t["fmt"].alias("fmt"), x.cast("long").alias("utc_ms"), t["cost"].alias("cost")))
    empty = F.array().cast(READINGS)
    abbr = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    # an abbreviation with several uses gives a reading each; the row's zone tells which is likely
    several = F.transform(
        abbr[t["z"]],
        lambda o, i: F.struct(
            F.when(F.size(abbr[t["z"]]) > 1, F.concat_ws("/", t["fmt"], t["z"], o.cast("string"))).otherwise(t["fmt"]).alias("fmt"),
            (t["ms"] - o * 60000).cast("long").alias("utc_ms"),
            (t["cost"] + F.when((i == 0) & (F.size(abbr[t["z"]]) == 1) | (_local(t["ms"], own) == t["ms"] - o * 60000), 0.0).otherwise(3 * SWITCH + i)).alias("cost"),
        ),
    )
    named = F.when(t["z"].isin(known), t["z"]).otherwise("UTC")
    return F.when(t["ms"].isNull(), empty).otherwise(
        F.when(t["z"] == "", one(_local(t["ms"], own)))
        .when(t["off"].isNotNull(), one(t["ms"] - t["off"]))
        .when(t["z"].contains("/") & t["z"].isin(known), one(_local(t["ms"], named)))
        .otherwise(F.coalesce(several, empty))
    )


READINGS = "array<struct<fmt:string,utc_ms:bigint,cost:double>>"


def _epochs(v: Column) -> Column:
    """Digits that count seconds or finer parts since 1970."""
    digits = F.regexp_replace(v, "^@", "")
    n = F.when(digits.rlike(r"^-?\d{1,18}$"), digits).cast("long")
    epoch = lambda f, t: F.array(F.struct(F.lit(f).alias("fmt"), t.cast("long").alias("utc_ms"), F.lit(0.0).alias("cost")))
    return (
        F.when(v.rlike(r"^@-?\d{1,10}$") | v.rlike(r"^\d{9,10}$"), epoch("epoch_s", n * 1000))
        .when(v.rlike(r"^@?\d{12,13}$"), epoch("epoch_ms", n))
        .when(v.rlike(r"^@?\d{15,16}$"), epoch("epoch_us", F.floor(n / 1000)))
        .when(v.rlike(r"^@?\d{18}$"), epoch("epoch_ns", F.floor(n / 1000000)))
        .when(v.rlike(r"^@?\d{19}$"), epoch("epoch_ns", F.substring(digits, 1, 13)))
        .when(v.rlike(r"^@?\d{9,10}[.,]\d+$"), epoch("epoch_s", F.regexp_replace(F.concat(digits, F.lit("000")), r"^(\d+)[.,](\d{3}).*$", "$1$2")))
        .otherwise(F.array().cast(READINGS))
    )


def readings(value: Column, zone: Column, known_zones: list[str], plain: bool = False) -> Column:
    """All readings of a value, as array<struct<fmt, utc_ms, cost>>.

    zone applies to local times whose value names none; null or an unknown zone is UTC. Digits
    below the millisecond are cut. Null, blank, text that is no date and dates or times that
    do not exist have an empty array, as have plain YYYY-MM-DD values unless ``plain``.
    """
    own = F.when(zone.isin(known_zones), zone).otherwise("UTC")
    shaped = lambda v: F.filter(
        F.array(*[F.when(v.rlike(p), F.concat(F.lit(f"{f}|"), F.regexp_replace(v, p, order))) for f, p, order in SHAPES]), lambda x: x.isNotNull()
    )
    each = lambda line: let(
        F.split(line, r"\|"), lambda parts: let(_numbers(parts), lambda t: let(_local_ms(t), lambda u: _instants(u, own, known_zones)))
    )
    empty = F.array().cast(READINGS)
    skip = lambda v: v.isNull() if plain else v.isNull() | v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    got = let(
        F.regexp_replace(F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", ""), rf"{SPACE}+", " "),
        lambda v: F.when(skip(v), empty).otherwise(F.concat(_epochs(v), F.flatten(F.transform(shaped(v), each)))),
    )
    return F.coalesce(got, empty)


def _move(f0: list, t0: list, f1: list, t1: list) -> np.ndarray:
    """Transition costs between the readings of two neighbouring records."""
    sw = np.array([[SWITCH * (a != b) for b in f1] for a in f0])
    jump = np.array([[JUMP * (b < a) for b in t1] for a in t0])
    return sw + jump


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """The rows in order: runs of records with one reading as frames, the others one by one."""
    for b in batches:
        open_ = np.flatnonzero(b["n"].to_numpy() > 1)
        at = 0
        for i in open_:
            if i > at:
                yield b.iloc[at:i], True
            yield b.iloc[i : i + 1], False
            at = i + 1
        if at < len(b):
            yield b.iloc[at:], True


def _record(rows: pd.DataFrame, k: int, certain: bool) -> tuple:
    r = rows.iloc[k]
    if certain:
        return r["source"], r["ord"], [r["fmt"]], [int(r["utc_ms"])], np.zeros(1)
    return r["source"], r["ord"], list(r["fmts"]), [int(t) for t in r["times"]], np.asarray(r["costs"], float)


def _boundary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per partition: its first and last record and the least-cost matrix between them.

    Costs within a run of certain records are the same on every course and are left out.
    """
    from pyspark import TaskContext

    first = last = head = run = None
    for rows, certain in _stretches(batches):
        for k in dict.fromkeys([0, len(rows) - 1]):
            src, _, f, t, c = _record(rows, k, certain)
            fresh = last is None or last[0] != src
            if (fresh and last is not None or k and rows["source"].iloc[0] != src) and head is None and first is not None:
                head = run.min(axis=1)
            if fresh:
                run = np.full((len(c), len(c)), np.inf)  # rows: readings of the source's first record here
                np.fill_diagonal(run, c)
                first = first or (src, f, t, c)
            elif k == 0:
                run = (run[:, :, None] + _move(last[1], last[2], f, t)[None]).min(axis=1) + c[None]
            last = (src, f, t)
    if first is not None:
        blob = pickle.dumps((first, last, head, run))
        yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "blob": [blob]})


def _settle(parts: list[tuple]) -> dict[int, tuple[int | None, int | None]]:
    """Per partition the readings of its first and last record on the best course over all.

    parts: (pid, first, last, head, run) in order. A chain is a stretch of partitions that one
    source runs through; its course is found forward and read backward.
    """
    fixed: dict[int, list] = {p[0]: [None, None] for p in parts}
    k = 0
    while k < len(parts):
        chain = [k]
        while k + 1 < len(parts) and parts[k][2][0] == parts[k + 1][1][0]:
            k += 1
            chain.append(k)
            if parts[k][3] is not None:
                break
        k += parts[k][3] is None or len(chain) == 1
        if len(chain) < 2:
            continue
        back, cost = [], parts[chain[0]][4].min(axis=0)
        for i, p in zip(chain, chain[1:]):
            step = cost[:, None] + _move(parts[i][2][1], parts[i][2][2], parts[p][1][1], parts[p][1][2])
            into, enter = step.argmin(axis=0), step.min(axis=0)
            if parts[p][3] is not None:
                back.append((into, None))
                cost = enter + parts[p][3]
            else:
                full = enter[:, None] + parts[p][4]
                back.append((into, full.argmin(axis=0)))
                cost = full.min(axis=0)
        j = int(cost.argmin())
        for i, p, (into, inside) in reversed(list(zip(chain, chain[1:], back))):
            if inside is not None:
                fixed[parts[p][0]][1] = j
                j = int(inside[j])
            fixed[parts[p][0]][0] = j
            j = int(into[j])
            fixed[parts[i][0]][1] = j
        # the first partition's last record is now fixed; its source's beginning is free
    return {p: tuple(v) for p, v in fixed.items()}


def _decode(fixed: dict[int, tuple]):
    """Viterbi within a partition whose first and last readings may be fixed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enter, leave = fixed.get(TaskContext.get().partitionId(), (None, None))
        held: tuple | None = None  # the certain record before the pending ones
        pend: list[tuple] = []
        cost, start = None, True

        def decided(j: int) -> pd.DataFrame:
            out = []
            for src, o, f, t, frm in reversed(pend):
                out.append((src, o, t[j], f[j]))
                j = int(frm[j]) if frm is not None else j
            pend.clear()
            return pd.DataFrame(out[::-1], columns=["source", "ord", "utc_ms", "fmt"])

        def settle(src: str, f: list, t: list) -> int:
            """The last pending reading, given the certain record that follows."""
            same = pend[-1][0] == src
            return int((cost + (_move(pend[-1][2], pend[-1][3], f, t)[:, 0] if same else 0)).argmin())

        for rows, certain in _stretches(batches):
            src, o, f, t, c = _record(rows, 0, certain)
            if certain:
                if pend:
                    yield decided(settle(src, f, t))
                yield rows[["source", "ord", "utc_ms", "fmt"]]
                held, start = _record(rows, len(rows) - 1, True), False
                continue
            if start and enter is not None:
                c = np.where(np.arange(len(c)) == enter, c, np.inf)
            start = False
            frm = None
            if pend and pend[-1][0] != src:
                yield decided(int(cost.argmin()))
            if pend:
                step = cost[:, None] + _move(pend[-1][2], pend[-1][3], f, t)
                frm, cost = step.argmin(axis=0), step.min(axis=0) + c
            else:
                cost = c + (_move(held[2], held[3], f, t)[0] if held and held[0] == src else 0)
            held = None
            pend.append((src, o, f, t, frm))
        if pend:
            yield decided(int(cost.argmin()) if leave is None else leave)

    return run


def choose(df: DataFrame, source: str, order: str, cands: str) -> DataFrame:
    """One reading per record by Viterbi over each source's record order.

    df: one row per (source, order); cands from ``readings``. Records without a reading take
    no part. Sorted range partitions share the work evenly however the records are spread
    over the sources; what a partition passes on is one small matrix, and the driver holds
    one of those per partition. Returns ``source, ord, utc_ms, fmt``; ties take the reading
    listed first. A null source counts as a source of its own, named ''.
    """
    spark = df.sparkSession
    got = df.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(order).cast("long").alias("ord"), F.col(cands).alias("c")).where(F.size("c") > 0)
    several = lambda f: F.when(F.size("c") > 1, F.col(f"c.{f}"))
    flat = got.select(
        "source", "ord", F.size("c").alias("n"), F.col("c")[0]["fmt"].alias("fmt"), F.col("c")[0]["utc_ms"].alias("utc_ms"),
        several("fmt").alias("fmts"), several("utc_ms").alias("times"), several("cost").alias("costs"),
    )
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = cut(flat.repartitionByRange(n, "source", "ord").sortWithinPartitions("source", "ord"))
    parts = [(r.pid, *pickle.loads(bytes(r.blob))) for r in laid.mapInPandas(_boundary, "pid int, blob binary").collect()]
    fixed = _settle(sorted(parts, key=lambda p: p[0]))
    return laid.mapInPandas(_decode(fixed), "source string, ord bigint, utc_ms bigint, fmt string")


def quoted(message: Column) -> Column:
    """The texts a validation message may quote, most specific first: array<string>.

    Within quotation marks, angle brackets, backticks or after ``value:``, else the message.
    """
    marks = (r"«([^»]*)»", r"`([^`]*)`", r"'([^']*)'", r'"([^"]*)"', r"[“„]([^”“]*)[”“]", r"<([^>]*)>", r"\((?:value|значение):\s*(.*)\)", r"(?:value|got|значение)\s*[:=]\s*(.*)$")
    found = [F.regexp_extract(message, m, 1) for m in marks]
    return F.filter(F.array(*found, message), lambda x: x.isNotNull() & (F.trim(x) != ""))
