"""Rule tables to issue rows: every rule is one predicate, all rules are checked in one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, severity, predicate that is true where the rule is broken, message)
Rule = tuple[str, str, Column, str]

# Vocabularies of the front matter.
STATUSES = ("draft", "published", "archived", "deleted")
DIFFICULTIES = ("beginner", "intermediate", "advanced")
REQUIRED = ("title", "date", "tags", "category")


def issues(df: DataFrame, key: str, rules: Iterable[Rule]) -> DataFrame:
    """(key, rule, severity, message) of every broken rule. A predicate that is null isn't broken."""
    found = F.array(*[F.when(p, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for r, s, p, m in rules])
    return df.select(F.col(key).alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("key", "i.rule", "i.severity", "i.message")


def empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def front_matter_rules() -> list[Rule]:
    """Rules over title, date, tags, category, status, difficulty, words and path."""
    c = F.col
    bad_enum = lambda name, values: ~empty(c(name)) & ~F.lower(F.trim(c(name))).isin(*values)
    return [
        ("title_missing", "high", empty(c("title")), "title is required"), ("date_missing", "high", empty(c("date")), "date is required"), ("category_missing", "high", empty(c("category")), "category is required"),
        ("tags_missing", "high", c("tags").isNull() | (F.size("tags") == 0), "tags are required"), ("tags_few", "low", c("tags").isNotNull() & F.size("tags").between(1, 2), "fewer than three tags"),
        ("title_long", "low", F.length("title") > 70, "title beyond 70 letters"), ("title_short", "low", ~empty(c("title")) & (F.length("title") < 5), "title below 5 letters"),
        ("date_format", "medium", ~empty(c("date")) & ~c("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date isn't YYYY-MM-DD"), ("status_unknown", "medium", bad_enum("status", STATUSES), "status is none of the list"),
        ("difficulty_unknown", "medium", bad_enum("difficulty", DIFFICULTIES), "difficulty is none of the list"), ("too_short", "medium", c("words") < 100, "fewer than 100 words"), ("short", "low", c("words").between(100, 299), "fewer than 300 words"),
        ("path_upper", "low", c("path").rlike("[A-ZА-ЯЁ][^/]*$"), "file name in upper case"), ("path_cyrillic", "low", c("path").rlike("[а-яА-ЯёЁ]"), "Cyrillic in the path"), ("path_space", "low", c("path").contains(" "), "blank in the path"),
        ("path_deep", "low", F.size(F.split("path", "/")) > 6, "more than six steps deep"),
    ]


def text_rules() -> list[Rule]:
    """Rules over the text of a document."""
    t = F.col("text")
    return [
        ("no_text", "high", empty(t), "no text"), ("no_heading", "medium", ~empty(t) & ~t.rlike(r"(?m)^#{1,6}\s"), "no heading"), ("no_sentence", "medium", ~empty(t) & ~t.rlike(r"[.!?]"), "no sentence"),
        ("code_without_language", "low", t.rlike(r"(?m)^```[ \t]*\r?\n[^`]"), "code block without a language"), ("empty_link", "high", t.rlike(r"\]\(\s*\)"), "link without a target"),
        ("image_without_alt", "medium", t.rlike(r"!\[\s*\]\("), "image without a description"), ("todo", "low", t.rlike(r"\b(TODO|FIXME)\b"), "open to-do"), ("long_line", "low", t.rlike(r"(?m)^[^\n]{2000,}$"), "line beyond 2000 letters"),
    ]


def score(points: DataFrame) -> DataFrame:
    """(key, score, grade): 100 less 20, 10 and 3 for each high, medium and low issue, at least 0."""
    minus = F.when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 10).otherwise(3)
    s = points.groupBy("key").agg(F.greatest(F.lit(0), 100 - F.sum(minus)).alias("score"))
    return s.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F"))
