"""Typed relations of a thesaurus: names, their owners and the parent each term names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.tables import latest

#: White space of any script and the zero-width marks, for trimming.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def name_key(c: Column) -> Column:
    """Name without letter case, outer white space and the blank / hyphen / underscore difference."""
    return F.trim(F.regexp_replace(F.lower(c), rf"(?:{SPACE}|[-_])+", " "))


def current_terms(thesaurus: DataFrame) -> DataFrame:
    """Current row per term_id: the one with the latest exported_at."""
    return latest(
        thesaurus, "term_id", "exported_at", F.col("term"), F.col("canonical"), F.col("synonyms"), F.col("broader"), F.col("origin")
    )


def term_parents(thesaurus: DataFrame) -> DataFrame:
    """term_id with the term_id its ``broader`` entries name, or null.

    A name belongs to the term that has it as term, else as canonical, else as synonym, the
    smallest id breaking ties. Of several known entries the first in the array counts; null,
    empty and unknown entries are ignored.
    """
    cur = current_terms(thesaurus)
    one = lambda c, rank: cur.select(F.explode(F.array(F.col(c))).alias("n"), "term_id", F.lit(rank).alias("rank"))
    names = one("term", 0).unionByName(one("canonical", 1)).unionByName(cur.select(F.explode("synonyms").alias("n"), "term_id", F.lit(2).alias("rank")))
    owners = (
        names.select(name_key(F.col("n")).alias("key"), "rank", "term_id").where("key <> ''").groupBy("key").agg(F.min(F.struct("rank", "term_id")).alias("o"))
    ).select("key", F.col("o.term_id").alias("parent_id"))
    asked = cur.select("term_id", F.posexplode("broader").alias("pos", "n")).select("term_id", "pos", name_key(F.col("n")).alias("key")).where("key <> ''")
    asked = asked.groupBy("term_id", "key").agg(F.min("pos").alias("pos"))
    # hot names (a third of all terms below one) are split by AQE: the left side is not grouped yet
    found = asked.join(owners, "key").groupBy("term_id").agg(F.min_by("parent_id", "pos").alias("parent_id"))
    return cur.select("term_id").join(found, "term_id", "left")
