"""Entities, relations, glossary, classes and topics from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import text as T

#: Keyword classes: class -> (number, keywords). A parameter of the classifier; these are the defaults.
CLASSES = {
    "computers": ("004", ("server", "сервер", "pipeline", "parser", "парсер", "index", "индекс")),
    "cooking": ("641", ("broth", "бульон", "омлет", "omelette", "десерт", "dessert")),
    "household": ("640", ("kettle", "чайник", "filter", "фильтр", "термостат", "thermostat")),
    "gardening": ("635", ("seedling", "рассада", "грядка", "garden", "садовый")),
}
#: Numbers of one classification in another, by their first digit.
OTHER_CODES = {"0": "Z", "6": "T"}


def entities(docs: DataFrame, id_col: str, text_col: str, dictionary: list[str]) -> DataFrame:
    """(doc, entity, kind, mentions): headings and dictionary words of a text. Null texts have none."""
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    words = d.select("doc", F.explode(F.filter(T.words(F.col("text")), lambda w: w.isin(dictionary))).alias("entity")).groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("mentions"))
    heads = d.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+([^\r\n]+)"), F.lit(1))).alias("h"))
    heads = heads.select("doc", F.lower(F.trim("h")).alias("entity")).where("entity <> ''").groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("mentions"))
    return words.withColumn("kind", F.lit("term")).unionByName(heads.withColumn("kind", F.lit("heading"))).select("doc", "entity", "kind", "mentions")


def sentence_relations(docs: DataFrame, id_col: str, text_col: str, dictionary: list[str]) -> DataFrame:
    """(a < b, n): dictionary words that stand in one sentence, with the number of sentences.

    Pairs come from each sentence's own set of dictionary words, which the dictionary bounds.
    """
    s = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[.!?]+")).alias("s"))
    e = s.select(F.array_sort(F.array_distinct(F.filter(T.words(F.col("s")), lambda w: w.isin(dictionary)))).alias("e")).where(F.size("e") > 1)
    pair = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return e.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def importance(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity, mentions, n_relations, importance): mentions and twice the relations."""
    m = found.groupBy("entity").agg(F.sum("mentions").alias("mentions"))
    r = relations.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_relations"))
    out = m.join(r, "entity", "left").na.fill(0, ["n_relations"])
    return out.withColumn("importance", F.col("mentions") + 2 * F.col("n_relations"))


def merge_entities(found: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, mentions, n_docs, aliases): entities under their common names. names: alias, name."""
    j = found.join(names.select(F.col("alias").alias("entity"), "name"), "entity", "left").withColumn("name", F.coalesce("name", "entity"))
    return j.groupBy(F.col("name").alias("entity")).agg(F.sum("mentions").alias("mentions"), F.countDistinct("doc").alias("n_docs"), F.countDistinct("entity").alias("aliases"))


def classify(words: Column, title_words: Column, classes: dict = CLASSES) -> Column:
    """struct<class, number, score>: the class with most keywords, those of the title three times; null without any.

    Ties take the class that comes first by name.
    """
    hits = lambda keys: F.size(F.filter(words, lambda w: w.isin(*keys))) + 3 * F.size(F.filter(title_words, lambda w: w.isin(*keys)))
    scored = F.array(*[F.struct(hits(k).alias("score"), F.lit(-i).alias("first"), F.lit(c).alias("class"), F.lit(no).alias("number")) for i, (c, (no, k)) in enumerate(sorted(classes.items()))])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, F.struct(best["class"].alias("class"), best["number"].alias("number"), best["score"].alias("score")))


def other_code(number: Column) -> Column:
    first = F.substring(number, 1, 1)
    out = F.lit("A")
    for k, v in OTHER_CODES.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def glossary(definitions: DataFrame) -> DataFrame:
    """Per term its first definition, articles and usage. definitions: term, definition, article."""
    d = definitions.where("term IS NOT NULL AND trim(term) <> ''")
    g = d.groupBy("term").agg(F.min_by("definition", F.struct("article", "definition")).alias("definition"), F.countDistinct("article").alias("n_articles"), F.count(F.lit(1)).alias("n_uses"))
    return g.withColumn("importance", F.col("n_articles") * 2 + F.col("n_uses")).withColumn("quality", definition_quality(F.col("term"), F.col("definition")))


def definition_quality(term: Column, definition: Column) -> Column:
    """0 to 100: length, no repetition of the term, more than two words."""
    n = F.length(F.trim(definition))
    return (
        F.when(n >= 20, 40).when(n >= 10, 20).otherwise(0) + F.when(F.lower(definition).contains(F.lower(term)), 0).otherwise(30) + F.when(F.size(F.split(F.trim(definition), r"\s+")) > 2, 30).otherwise(0)
    )


def keyword_pairs(keywords: DataFrame, least: int = 3) -> DataFrame:
    """(a < b, n): keywords that n documents share among their best. keywords: doc, word; the best of a document are few."""
    k = keywords.groupBy("doc").agg(F.sort_array(F.collect_set("word")).alias("ws"))
    pair = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return k.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def topics(docs: DataFrame, id_col: str, text_col: str, k: int = 3, per: int = 3) -> DataFrame:
    """(doc, topic, words): the k x per most frequent words of each text dealt to k topics by rank; ties by word."""
    w = docs.select(F.col(id_col).alias("doc"), F.explode(T.words(F.col(text_col), 4, stop_words=True)).alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))
    r = w.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "word")) - 1).where(F.col("r") < k * per)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"])
    return r.groupBy("doc", (F.col("r") % k).alias("topic")).agg(F.array_join(listed, " ").alias("words"))


def note_importance(text: Column) -> Column:
    """5, more for marks of urgency, questions, links and length; 10 at most."""
    t = F.lower(F.coalesce(text, F.lit("")))
    s = 5 + F.when(t.rlike("fix|todo|важно|important|urgent"), 2).otherwise(0) + F.when(t.contains("?"), 1).otherwise(0) + F.when(t.rlike("https?://"), 1).otherwise(0) + F.when(F.length(t) > 40, 1).otherwise(0)
    return F.least(F.lit(10), s)


def together(pairs: DataFrame, of: DataFrame, top: int = 5) -> DataFrame:
    """(item, other, common, surprise, k): what the readers of an item also read. pairs: reader, item; of: item.

    surprise is 1 - common / readers of the other item. Of equal numbers the smaller item comes first.
    """
    p = pairs.where("reader IS NOT NULL AND item IS NOT NULL").distinct()
    size = p.groupBy("item").agg(F.count(F.lit(1)).alias("readers"))
    mine = p.join(of.select("item").distinct(), "item", "left_semi")
    both = mine.join(p.select("reader", F.col("item").alias("other")), "reader").where("item <> other").groupBy("item", "other").agg(F.count(F.lit(1)).alias("common"))
    out = both.join(size.withColumnRenamed("item", "other"), "other").withColumn("surprise", 1 - F.col("common") / F.col("readers"))
    w = W.partitionBy("item").orderBy(F.desc("common"), "other")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("item", "other", "common", "surprise", "k")
