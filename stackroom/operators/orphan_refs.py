"""References to records that do not exist.

Parent and child keys are brought into one long form (kind of row, parent table, key, time),
grouped by parent table and key, and the keys without a live parent are kept; children are
then read against those keys only. Groups hold counters and extremes, never rows, so a key
named by a third of all children costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import let
from stackroom.operators.thesaurus import SPACE
from stackroom.session import materialize
from stackroom.skew import lookup


def plain_path(entry: Column, base: Column) -> Column:
    """The plain path of the file an entry names, or null if it names none.

    entry: a link as typed; base: the path of the file it stands in. From the root when the
    entry begins with a slash or ``knowledge/``, else relative to base's directory. Fragments
    and queries go first, then percent-escapes are read (a broken escape stays as it is),
    backslashes become slashes, empty and ``.`` steps vanish, ``..`` goes up (not above the
    root). Null, empty, bare fragments and queries, web and mail addresses name no file, nor
    does a relative entry whose base is null.
    """
    trim = lambda c: F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
    outside = lambda raw: raw.rlike(r"(?i)^(?:[a-z][a-z0-9+.]+:|www\.)") | raw.rlike(r"^[^/\s@]+@[^/\s@]+\.[^/\s@]+$")
    # try_url_decode gives null where the bytes are no UTF-8: such text is taken literally
    decoded = lambda head: F.when(head.contains("%"), F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(head, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))), head)).otherwise(head)
    text = lambda raw: trim(F.replace(let(F.regexp_replace(raw, r"[#?][\s\S]*$", ""), decoded), F.lit("\\"), F.lit("/")))
    folder = F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), r"[^/]*$", "")
    steps = lambda full: F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    plain = lambda t: F.when(t != "", F.nullif(F.array_join(steps(F.when(t.rlike(r"^(?:/|knowledge/)"), t).otherwise(F.concat(folder, t))), "/"), F.lit("")))
    return let(trim(entry), lambda raw: F.when(raw.isNotNull() & ~outside(raw), let(text(raw), plain)))


def find_orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose parent is missing, deleted or came later.

    parents: ``parent_table, key, deleted, since`` - one or more rows per key, deleted telling
    whether the current record is deleted, since the time of the row. children: ``src_table,
    src_id, parent_table, key, at``. A null key refers to nothing; a null ``at`` is never late.
    Repeated children give one row. Returns ``src_table, src_id, parent_table, key, kind, at``;
    an empty parents table makes every child missing, an empty children table gives none.
    """
    # grouped with the parents and joined with the outcome: the children are worked out once
    kids = materialize(children.select("src_table", "src_id", "parent_table", "key", "at").where("key IS NOT NULL").distinct(), "children")
    long = parents.where("key IS NOT NULL").select("parent_table", "key", F.lit(1).alias("is_parent"), F.col("deleted").cast("int").alias("deleted"), "since", F.lit(None).cast("timestamp").alias("at"))
    long = long.unionByName(
        kids.select("parent_table", "key", F.lit(0).alias("is_parent"), F.lit(0).alias("deleted"), F.lit(None).cast("timestamp").alias("since"), "at")
    )
    state = long.groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("found"), F.max("deleted").alias("deleted"), F.min("since").alias("since"), F.min("at").alias("first_at"), F.min("is_parent").alias("all_parent")
    )
    failing = state.where("all_parent = 0 AND (found = 0 OR deleted = 1 OR first_at < since)").select(
        F.struct("parent_table", "key").alias("ref"), "found", "deleted", "since"
    )
    hit = lookup(kids.withColumn("ref", F.struct("parent_table", "key")), failing, "ref", "inner")
    kind = F.when(F.col("found") == 0, "missing").when(F.col("deleted") == 1, "deleted").when(F.col("since") > F.col("at"), "late")
    return hit.select("src_table", "src_id", "parent_table", "key", kind.alias("kind"), "at").where("kind IS NOT NULL")


def orphan_counts(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphan references per source table, kind and period of their time."""
    return orphans.groupBy("src_table", "kind", F.date_trunc(period, F.col("at")).alias("period")).agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_targets")
    )
