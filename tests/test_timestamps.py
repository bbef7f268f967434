import itertools
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stackroom.operators import timestamps as S


def ms(*a, frac=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1000 + frac


CASES = [
    ("2024-05-25T13:33:51Z", None, ms(2024, 5, 25, 13, 33, 51)), ("2024-05-31 13:33:42,084+03:00", "UTC", ms(2024, 5, 31, 10, 33, 42, frac=84)), ("2023-01-05 18:21:56.284597903+01:00", None, ms(2023, 1, 5, 17, 21, 56, frac=284)),
    ("2024-04-26 07:38:20.9-03:30", None, ms(2024, 4, 26, 11, 8, 20, frac=900)), ("2024-03-01T03:36:31+09:00[Asia/Tokyo]", "UTC", ms(2024, 2, 29, 18, 36, 31)), ("2023-01-27 10:17:39 America/New_York", None, ms(2023, 1, 27, 15, 17, 39)),
    ("2024-08-21 04:30:59 EDT", None, ms(2024, 8, 21, 8, 30, 59)), ("30.04.2024 05:42:28 GMT+5", "Europe/Berlin", ms(2024, 4, 30, 0, 42, 28)), ("09.11.2024 04:04:14 GMT-07:30", "Asia/Tokyo", ms(2024, 11, 9, 11, 34, 14)),
    ("28.07.2023 07:39:07", "Europe/Berlin", ms(2023, 7, 28, 5, 39, 7)), ("03.02.2025", None, ms(2025, 2, 3)), ("09/13/2024 12:07 PM", "Europe/Berlin", ms(2024, 9, 13, 10, 7)), ("01/02/2024 12:07 AM", None, ms(2024, 1, 2, 0, 7)),
    ("Wed Jul 3 18:42:55 2024 +0930", "UTC", ms(2024, 7, 3, 9, 12, 55)), ("Tue, 10 Jan 2023 18:10:20 GMT", "Asia/Tokyo", ms(2023, 1, 10, 18, 10, 20)), ("08 янв. 2023 03:31:20", None, ms(2023, 1, 8, 3, 31, 20)),
    ("10 января 2023 г., 15:31", "Europe/Moscow", ms(2023, 1, 10, 12, 31)), ("5 мая 2023", "Europe/Moscow", ms(2023, 5, 4, 21)), ("Jan 11, 2023 6:20 PM", None, ms(2023, 1, 11, 18, 20)), ("20230103T025733Z", "Asia/Kolkata", ms(2023, 1, 3, 2, 57, 33)),
    ("20230114", None, ms(2023, 1, 14)), ("20230101052951", None, ms(2023, 1, 1, 5, 29, 51)), ("@1672996725", "UTC", 1672996725000), ("1673120925", None, 1673120925000), ("1672672083962", None, 1672672083962), ("1672974151149425", None, 1672974151149),
    ("datetime.date(2023, 1, 25)", None, ms(2023, 1, 25)), ("datetime.datetime(2023, 2, 12, 23, 55, 32)", None, ms(2023, 2, 12, 23, 55, 32)), ("datetime.datetime(2023, 2, 12, 23, 55, 32, 4500)", None, ms(2023, 2, 12, 23, 55, 32, frac=4)),
    ("2024/05/26", None, ms(2024, 5, 26)), ("2024-08-02T03:08", "Europe/Berlin", ms(2024, 8, 2, 1, 8)), ("2023-06-05T22:02:40+00", None, ms(2023, 6, 5, 22, 2, 40)),
    # twice: the first time, unless the value tells; skipped: the offset before the change
    ("2024-10-27 02:30:00", "Europe/Berlin", ms(2024, 10, 27, 0, 30)), ("2024-10-27 02:30:00 CET", "Europe/Berlin", ms(2024, 10, 27, 1, 30)), ("2024-03-31 02:30:00", "Europe/Berlin", ms(2024, 3, 31, 1, 30)),
    ("2023-01-01 00:00:00 IST", "Asia/Kolkata", ms(2022, 12, 31, 18, 30)), ("2023-01-02 19:32:21", "No/Where", ms(2023, 1, 2, 19, 32, 21)),
    *[(v, None, None) for v in ("2024-05-25", " 2024-05-25 ", "", "  ", None, "вчера", "Q3 2025", "00.00.0000", "2025-06-31T08:00:00Z", "2024-13-01 10:00:00", "2024-01-01 25:00:00", "29.02.2023", "13/13/2024", "n/a", "x" * 5000)],
]


def test_readings(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i long, v string, z string")
    got = df.select("i", S.readings(F.col("v"), F.col("z"), S.zone_ids(spark)).alias("c"))
    best = {r.i: (min(r.c, key=lambda c: c.cost).utc_ms if r.c else None) for r in got.collect()}
    assert [(CASES[i][0], best[i]) for i in sorted(best)] == [(v, w) for v, _, w in CASES]


def test_quoted(spark):
    m = ["Invalid date format (expected YYYY-MM-DD): '2023/07/03 20:04:27'", "date: значение «5 мая 2023» не распознано", "got <2024/04/17>", "Wrong type (value: 2024-02-30)", "date = `x` is not YYYY-MM-DD", "plain"]
    got = [r[0][0] for r in spark.createDataFrame([(x,) for x in m], "m string").select(S.quoted(F.col("m"))).collect()]
    assert got == ["2023/07/03 20:04:27", "5 мая 2023", "2024/04/17", "2024-02-30", "x", "plain"]


def cost(path):
    c = sum(x[2] for x in path)
    for a, b in zip(path, path[1:]):
        c += S.SWITCH * (a[0] != b[0]) + S.JUMP * (b[1] < a[1])
    return c


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_optimal_across_partitions(spark, seed):
    """The chosen course costs no more than any other, wherever the partitions end."""
    r = random.Random(seed)
    data = []
    for src in ("a", "b", "c")[: 1 + seed % 3]:
        for k in range(9 if seed < 5 else 1):
            n = r.choice([1, 2, 2, 3]) if seed != 3 else 2
            data.append((src, k, [(f"f{r.randrange(3)}{j}", r.randrange(20), float(r.choice([0, 0, 1]))) for j in range(n)]))
    df = spark.createDataFrame(data, "source string, k long, c array<struct<fmt:string,utc_ms:long,cost:double>>")
    got = {(x.source, x.ord): (x.fmt, x.utc_ms) for x in S.choose(df, "source", "k", "c").collect()}
    assert len(got) == len(data)
    for src in {d[0] for d in data}:
        mine = [d for d in data if d[0] == src]
        best = min(cost(p) for p in itertools.product(*[d[2] for d in mine]))
        # readings with equal format and time but another cost: the cheapest is meant
        chosen = [min((c for c in d[2] if (c[0], c[1]) == got[src, d[1]]), key=lambda c: c[2]) for d in mine]
        assert cost(chosen) == best


def test_empty(spark):
    df = spark.createDataFrame([], "source string, k long, c array<struct<fmt:string,utc_ms:long,cost:double>>")
    assert S.choose(df, "source", "k", "c").count() == 0


def test_neighbours_decide(spark):
    """An abbreviation of three zones is read so that time does not go back, whatever its usual zone."""
    zones = S.zone_ids(spark)
    told = ["2024-03-01T08:30:00Z", "2024-03-01T10:00:00 IST", "2024-03-01T09:30:00Z"]
    ms = lambda h, m: (19783 * 24 * 60 + h * 60 + m) * 60000
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(told)] + [("t", 0, told[1])], "src string, n long, v string")
    got = S.choose(df.withColumn("c", S.readings(F.col("v"), F.lit(None).cast("string"), zones)), "src", "n", "c")
    assert [r.utc_ms for r in got.orderBy("source", "ord").collect()] == [ms(8, 30), ms(9, 0), ms(9, 30), ms(4, 30)]
