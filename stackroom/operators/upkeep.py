"""Upkeep of a corpus: versions of texts, archives, vocabularies, paths, sitemaps, trends of interest, arrays of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Extension classes with the ratio their files are expected to shrink by.
RATIOS = {"text": 3.0, "code": 2.5, "other": 2.0, "packed": 1.0}
EXTENSIONS = {"md": "text", "txt": "text", "csv": "text", "py": "code", "js": "code", "json": "code", "zip": "packed", "gz": "packed", "png": "packed", "jpg": "packed"}


def extension_class(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.(\w+)$", 1))
    out = F.lit("other")
    for e, c in EXTENSIONS.items():
        out = F.when(ext == e, c).otherwise(out)
    return out


def compression(files: DataFrame) -> DataFrame:
    """(class, n, bytes, expected_bytes). files: path, bytes; null sizes count as 0."""
    c = files.select(extension_class(F.col("path")).alias("class"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    ratio = F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))])
    g = c.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return g.withColumn("expected_bytes", F.col("bytes") / ratio[F.col("class")])


def backup_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("full"), "full").when(n.contains("diff"), "differential").when(n.contains("incr"), "incremental").otherwise("unknown")


def rotated(backups: DataFrame, keep: int = 10) -> DataFrame:
    """Backups beyond the newest ``keep`` of each kind. backups: name, at. Only a bounded report of each kind is ranked last."""
    b = backups.withColumn("kind", backup_kind(F.col("name")))
    w = W.partitionBy("kind").orderBy(F.desc("at"), "name")
    return b.withColumn("k", F.row_number().over(w)).where(F.col("k") > keep)


def line_changes(old: Column, new: Column) -> Column:
    """struct<added, removed, kept>: lines of two texts as multisets, in one expression. Null texts have no lines."""
    lines = lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, "\r?\n"))
    # the n-th copy of a line is told from the others by its number
    def numbered(ls: Column) -> Column:
        s = F.array_sort(ls)
        return F.transform(s, lambda x, i: F.concat(x, F.lit("\u0000"), (i - F.array_position(s, x) + 1).cast("string")))

    a, b = numbered(lines(old)), numbered(lines(new))
    return F.struct(F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"), F.size(F.array_intersect(a, b)).alias("kept"))


def annotated(changes: DataFrame) -> DataFrame:
    """(path, author, lines, share): who wrote how much of a file. changes: path, author, insertions, deletions."""
    g = changes.where("path IS NOT NULL").groupBy("path", "author").agg(F.sum(F.greatest(F.col("insertions") - F.col("deletions"), F.lit(0))).alias("lines"))
    total = g.groupBy("path").agg(F.sum("lines").alias("total"))
    return g.join(total, "path").select("path", "author", "lines", F.when(F.col("total") > 0, F.col("lines") / F.col("total")).alias("share"))


def path_issues(path: Column, title: Column) -> Column:
    """array<string>: no_path, too_deep (over six steps), many_crumbs (over seven), short_title, upper_case, blank."""
    depth = F.size(F.split(path, "/"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(path, F.lit("")) == "", "no_path"), F.when(depth > 6, "too_deep"), F.when(depth > 7, "many_crumbs"), F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) < 3, "short_title"),
            F.when(path != F.lower(path), "upper_case"), F.when(path.contains(" "), "blank"),
        )
    )


def sitemap_issues(urls: DataFrame, most: int = 50_000) -> DataFrame:
    """(file, issue, n): repeated or malformed addresses, priorities outside 0 to 1, files over ``most``. urls: file, url, priority."""
    one = urls.groupBy("file", "url").agg(F.count(F.lit(1)).alias("n"))
    repeated = one.where("n > 1").groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("issue", F.lit("repeated"))
    kinds = F.array_compact(F.array(F.when(~F.coalesce(F.col("url").rlike(r"^https?://[^\s]+$"), F.lit(False)), "format"), F.when(~F.coalesce(F.col("priority").between(0, 1), F.lit(True)), "priority")))
    each = urls.select("file", F.explode(kinds).alias("issue")).groupBy("file", "issue").agg(F.count(F.lit(1)).alias("n"))
    large = urls.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).withColumn("issue", F.lit("too_many"))
    return each.unionByName(repeated.select("file", "issue", "n")).unionByName(large.select("file", "issue", "n"))


def trend(edits: Column, days: Column, links: Column, quality: Column) -> Column:
    """struct<growth, viral, momentum, direction> of an article's edits, age in days, links and quality. Null counts as 0, days as 1 at least."""
    e, n, l, q = (F.coalesce(c, F.lit(0)).cast("double") for c in (edits, days, links, quality))
    n = F.greatest(n, F.lit(1.0))
    growth = F.when(n < 30, e / n).otherwise(0.0)
    viral = l / F.sqrt(n)
    momentum = growth * 50 + viral * 30 + q * 0.2
    return F.struct(growth.alias("growth"), viral.alias("viral"), momentum.alias("momentum"), F.when(momentum >= 20, "rising").when(momentum >= 8, "steady").otherwise("falling").alias("direction"))


def orphan_impact(outlinks: Column, potential: Column, pagerank: Column, tags: Column) -> Column:
    """struct<connectivity, rating, lost_rank, discoverability> of an article that nothing links to. Null counts as 0."""
    o, p, r, t = (F.coalesce(c, F.lit(0)) for c in (outlinks, potential, pagerank, tags))
    c = o + p * 2
    return F.struct(
        c.cast("long").alias("connectivity"), F.when(c >= 20, "high").when(c >= 8, "medium").otherwise("low").alias("rating"), (r * 0.85 * F.when(o > 0, 1.0).otherwise(0.5)).alias("lost_rank"),
        F.least(F.lit(100), t * 10 + o * 5).cast("int").alias("discoverability"),
    )


# arrays of values


def keep(values: Column, rule: str, bound: Column | float | None = None) -> Column:
    """Values of an array by a rule: greater, less, equal, unequal (than a bound), positive, negative, non_zero, unique. Nulls are dropped."""
    b = F.lit(bound) if bound is not None and not isinstance(bound, Column) else bound
    tests = {"greater": lambda x: x > b, "less": lambda x: x < b, "equal": lambda x: x == b, "unequal": lambda x: x != b, "positive": lambda x: x > 0, "negative": lambda x: x < 0, "non_zero": lambda x: x != 0}
    return F.array_distinct(F.array_compact(values)) if rule == "unique" else F.filter(values, lambda x: F.coalesce(tests[rule](x), F.lit(False)))


def arranged(values: Column, how: str) -> Column:
    """An array ascending, descending, reversed, or each value once in order."""
    return {"ascending": lambda: F.array_sort(values), "descending": lambda: F.sort_array(values, asc=False), "reversed": lambda: F.reverse(values), "unique": lambda: F.array_distinct(values)}[how]()


def found_at(values: Column, x: Column) -> Column:
    """Place from 0 of a value in the sorted array, -1 if it is not there."""
    return (F.coalesce(F.array_position(F.array_sort(values), x), F.lit(0)) - 1).cast("int")


def character_stats(text: Column) -> Column:
    """struct<n, distinct, ratio, entropy> of a text's characters."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    n = F.size(chars)
    share = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda c: c == k)) / n)
    h = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.struct(n.alias("n"), F.size(kinds).alias("distinct"), F.when(n > 0, F.size(kinds) / n).alias("ratio"), F.when(n > 0, h).alias("entropy"))


def parsed_lines(text: Column, delimiter: str = ",") -> Column:
    """array<map<header, value>> of delimited text without quoting; missing cells are null, a text without rows is empty."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda l: F.trim(l) != "")
    head = F.transform(F.split(F.get(lines, F.lit(0)), delimiter), lambda h: F.trim(h))
    row = lambda l: F.map_from_arrays(head, F.transform(head, lambda h, i: F.trim(F.get(F.split(l, delimiter), i))))
    return F.when(F.size(lines) > 1, F.transform(F.slice(lines, F.lit(2), F.size(lines) - 1), row)).otherwise(F.array().cast("array<map<string,string>>"))


def drawn(key: Column, seed: int, low: int, high: int) -> Column:
    """A whole number from low to high drawn by a hash of key and seed: the same on every run, dice and coins included."""
    return (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 8), 16, 10).cast("long"), F.lit(high - low + 1)) + low).cast("int")


def drawn_id(key: Column, seed: int) -> Column:
    """An identifier of the usual 8-4-4-4-12 form drawn by a hash of key and seed."""
    h = F.md5(F.concat_ws(":", F.lit(seed), key))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
