"""Row-wise renderings as Column functions and writers that keep them distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.scalar import html_escape

# Markdown patterns and their HTML, applied in order.
MARKDOWN = (
    (r"(?s)```(\w*)\r?\n(.*?)```", r'<pre><code class="$1">$2</code></pre>'), (r"`([^`\n]+)`", "<code>$1</code>"),
    *[(rf"(?m)^{'#' * n}[ \t]+([^\r\n]+)", f"<h{n}>$1</h{n}>") for n in range(6, 0, -1)],
    (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"\*([^*\n]+)\*", "<em>$1</em>"), (r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", '<img src="$2" alt="$1">'), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    (r"(?m)^[ \t]*[-*+][ \t]+([^\r\n]+)", "<li>$1</li>"), (r"(?:\r?\n){2,}", "\n<p>\n"),
)


def markdown_to_html(text: Column) -> Column:
    for p, r in MARKDOWN:
        text = F.regexp_replace(text, p, r)
    return text


def markdown_to_text(text: Column) -> Column:
    """Markup removed, labels of links kept."""
    for p, r in ((r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", "$1"), (r"(?m)^[ \t]*[-*+>][ \t]+", "")):
        text = F.regexp_replace(text, p, r)
    return text


def html_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), html_escape(title), F.lit("</title></head><body>"), markdown_to_html(body), F.lit("</body></html>"))


def xml_article(path: Column, title: Column, category: Column, tags: Column) -> Column:
    tag = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<tag>"), html_escape(t), F.lit("</tag>"))), "")
    some = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), html_escape(c), F.lit(f"</{name}>"))).otherwise("")
    return F.concat(F.lit("<article>"), some("path", path), some("title", title), some("category", category), F.lit("<tags>"), F.coalesce(tag, F.lit("")), F.lit("</tags></article>"))


def latex_section(title: Column, body: Column) -> Column:
    esc = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    return F.concat(F.lit("\\section{"), esc(title), F.lit("}\n"), esc(markdown_to_text(body)))


def json_ld_breadcrumbs(path: Column) -> Column:
    """schema.org BreadcrumbList of a path."""
    steps = F.split(path, "/")
    items = F.transform(steps, lambda s, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), s.alias("name"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/").alias("item")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))


def sitemap_url(loc: Column, lastmod: Column, priority: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), html_escape(loc), F.lit("</loc><lastmod>"), F.date_format(lastmod, "yyyy-MM-dd"), F.lit("</lastmod><priority>"), F.format_string("%.1f", priority), F.lit("</priority></url>"))


def rss_item(title: Column, link: Column, at: Column) -> Column:
    return F.concat(F.lit("<item><title>"), html_escape(title), F.lit("</title><link>"), html_escape(link), F.lit("</link><pubDate>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>"))


def graphml_edge(src: Column, dst: Column) -> Column:
    return F.concat(F.lit('<edge source="'), html_escape(src), F.lit('" target="'), html_escape(dst), F.lit('"/>'))


def turtle_triple(s: Column, p: Column, o: Column) -> Column:
    name = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")
    return F.concat(F.lit("kb:"), name(s), F.lit(" kb:"), name(p), F.lit(" kb:"), name(o), F.lit(" ."))


def cypher_relation(s: Column, p: Column, o: Column) -> Column:
    q = lambda c: F.replace(c, F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("MATCH (a {name: '"), q(s), F.lit("'}), (b {name: '"), q(o), F.lit("'}) CREATE (a)-[:"), F.upper(p), F.lit("]->(b);"))


# writers: each partition writes its own files


def write_text(df: DataFrame, line: Column, path: str, compression: str = "none") -> None:
    df.select(line.alias("value")).where("value IS NOT NULL").write.mode("overwrite").option("compression", compression).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by semicolons; CSV has no nested values."""
    cols = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_xml(df: DataFrame, path: str, row: str = "article", root: str = "articles") -> None:
    df.write.mode("overwrite").option("rowTag", row).option("rootTag", root).format("xml").save(path)


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings sorted by word in hashed buckets: a search reads one bucket's few row groups."""
    b = postings.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    b.repartition(buckets, "bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(path)
