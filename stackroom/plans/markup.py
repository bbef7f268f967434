"""Figures, captions, DOIs, excerpts, references and citations, on articles rendered to Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackroom.functions import markup as M
from stackroom.plans.catalog import ART, arts

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: An article as Markdown, the same expression for both engines.
RENDERED = """'# ' || coalesce(title, '') || chr(10) || '![' || CASE WHEN id % 4 = 0 THEN '' ELSE coalesce(title, '') END || '](img/' || subcategory || '-' || CAST(id % 97 AS STRING) || CASE id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.svg' END || ' "' || category || '")' || chr(10)
|| 'Рис. ' || CAST(id % 9 AS STRING) || '. ' || coalesce(title, '-') || chr(10) || 'See fig. ' || CAST(id % 9 AS STRING) || ' and [' || CAST(id % 5 AS STRING) || '], #' || CAST(id % 50 AS STRING) || ' @notes/' || subcategory || '.md [[' || category || ']].' || chr(10)
|| '> ' || coalesce(title, '') || ' is quoted at length' || chr(10) || '**' || coalesce(title, '') || ' in ' || category || '**' || chr(10) || 'Important ' || status || ' remark. Rule of the ' || category || ' shelf. Это ' || subcategory || ' — это раздел. For example ' || author || '.' || chr(10)
|| 'See [home](/index.md), 10.' || CAST(1000 + id % 50 AS STRING) || '/KB.' || CAST(id % 40 AS STRING) || ', https://doi.org/10.1234/x' || CAST(id % 7 AS STRING) || chr(10) || CASE WHEN id % 6 = 0 THEN '![dot](data:image/gif;base64,R0lGODlhAQABAAAAACw=)' || chr(10) ELSE '' END || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10)"""
MD = f"{ART}, md AS (SELECT id, path, category, subcategory, author, title, modified, {RENDERED} AS text FROM art)"
IMG = r"""'!\[([^\]]*)\]\(([^)\s]+)(?:[ \t]+"([^"]*)")?\)'"""
IM = f"""im AS (SELECT id, path, category, unnest(regexp_extract_all(text, {IMG}, 1)) AS alt, unnest(regexp_extract_all(text, {IMG}, 2)) AS url, unnest(regexp_extract_all(text, {IMG}, 3)) AS title, unnest(range(len(regexp_extract_all(text, {IMG}, 2)))) AS pos FROM md),
iq AS (SELECT *, CASE WHEN starts_with(url, 'data:') THEN regexp_extract(url, '^data:image/(\\w+)', 1) ELSE lower(regexp_extract(url, '\\.(\\w+)(?:[?#].*)?$', 1)) END AS format, CASE WHEN starts_with(url, 'data:') THEN (length(replace(regexp_extract(url, '^data:[^,]*;base64,(.*)$', 1), '=', '')) * 3 // 4)::INT END AS embedded_bytes,
CASE WHEN length(trim(alt)) = 0 THEN 0 ELSE 40 + CASE WHEN length(trim(alt)) >= 10 THEN 30 ELSE 0 END + CASE WHEN length(trim(alt)) <= 125 THEN 20 ELSE 0 END + CASE WHEN contains(trim(alt), ' ') THEN 10 ELSE 0 END END AS quality FROM im)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def rendered(spark, d):
    return arts(spark, d).select("id", "path", "category", "subcategory", "author", "title", "modified", F.expr(RENDERED).alias("text"))


def _images(spark, d):
    i = rendered(spark, d).select("id", "path", "category", F.posexplode(M.images(F.col("text"))).alias("pos", "i")).select("id", "path", "category", "pos", "i.*")
    return i.withColumn("format", M.image_format(F.col("url"))).withColumn("quality", M.alt_quality(F.col("alt")))


@query(f"WITH {MD}, {IM} SELECT id, alt, url, coalesce(title, '') AS title, embedded_bytes FROM iq")
def image_index(spark, d):
    return _images(spark, d).select("id", "alt", "url", "title", "embedded_bytes")


@query(f"WITH {MD}, {IM} SELECT format, count(*) AS n, count(DISTINCT url) AS n_files, round(avg(quality), 6) AS mean_quality, sum((quality < 50)::INT)::BIGINT AS poor, sum((quality >= 80)::INT)::BIGINT AS good FROM iq GROUP BY format")
def image_formats(spark, d):
    """Images by format, with how good their texts are."""
    return _images(spark, d).groupBy("format").agg(
        n(), F.countDistinct("url").alias("n_files"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count_if(F.col("quality") < 50).alias("poor"), F.count_if(F.col("quality") >= 80).alias("good"),
    )


@query(f"WITH {MD}, {IM} SELECT id, url, kind FROM (SELECT id, url, unnest([CASE WHEN trim(alt) = '' THEN 'no_alt' END, CASE WHEN quality BETWEEN 1 AND 49 THEN 'poor_alt' END, CASE WHEN embedded_bytes IS NULL AND format NOT IN ('png', 'jpg', 'gif') THEN 'format' END, CASE WHEN title IS NULL OR title = '' THEN 'no_title' END]) AS kind FROM iq) WHERE kind IS NOT NULL")
def image_issues(spark, d):
    q = F.col("quality")
    kinds = [F.when(F.trim("alt") == "", "no_alt"), F.when(q.between(1, 49), "poor_alt"), F.when(F.col("embedded_bytes").isNull() & ~F.col("format").isin("png", "jpg", "gif"), "format"), F.when(F.coalesce("title", F.lit("")) == "", "no_title")]
    return _images(spark, d).select("id", "url", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


@query(f"WITH {MD}, {IM}, f AS (SELECT DISTINCT 'img/' || subcategory || '-' || CAST(words % 97 AS STRING) || '.png' AS url FROM art WHERE words IS NOT NULL) SELECT url FROM f WHERE url NOT IN (SELECT url FROM iq)")
def orphaned_images(spark, d):
    """Image files (names made of word counts here) that no article shows."""
    files = arts(spark, d).where("words IS NOT NULL").selectExpr("'img/' || subcategory || '-' || CAST(words % 97 AS STRING) || '.png' AS url").distinct()
    return files.join(_images(spark, d).select("url").distinct(), "url", "left_anti")


@query(f"WITH {MD}, {IM}, c AS (SELECT category, count(*) AS k FROM iq GROUP BY category), b AS (SELECT category, row_number() OVER (ORDER BY category) AS no FROM c) SELECT id, url, b.no || '.' || row_number() OVER (PARTITION BY iq.category, iq.format ORDER BY id, pos) AS number FROM iq JOIN b USING (category)")
def figure_numbers(spark, d):
    """Running number of each figure within its category and format, after the category's own number."""
    i = _images(spark, d)
    cats = i.select("category").distinct().withColumn("no", F.row_number().over(W.orderBy("category")))  # a row per category
    # numbers within a hashed bucket of ids go on from the smaller buckets: no category is one task
    b = i.withColumn("b", F.floor(F.col("id") / 4096))
    from stackroom.skew import bucket_offsets

    before = bucket_offsets(b, ["category", "format"], "b", F.lit(1))
    own = F.row_number().over(W.partitionBy("category", "format", "b").orderBy("id", "pos"))
    out = b.withColumn("own", own).join(before, ["category", "format", "b"]).join(F.broadcast(cats), "category")
    return out.select("id", "url", F.concat_ws(".", "no", (F.col("own") + F.col("_before")).cast("string")).alias("number"))


CAP = r"'(?m)^[*_]?(?:Рис|Рисунок|Fig|Figure|Таблица|Table)\.?[ \t]*\d+[.:]?[ \t]*([^\r\n*_]+)'"


@query(f"WITH {MD}, c AS (SELECT id, trim(unnest(regexp_extract_all(text, {CAP}, 1))) AS caption FROM md) SELECT caption, count(*) AS n, min(id) AS first_id, length(caption)::INT AS chars FROM c GROUP BY caption")
def figure_captions(spark, d):
    """Captions with how often they occur; repeated ones are duplicates."""
    c = rendered(spark, d).select("id", F.explode(M.captions(F.col("text"))).alias("caption"))
    return c.groupBy("caption").agg(n(), F.min("id").alias("first_id")).withColumn("chars", F.length("caption"))


@query(f"WITH {MD}, c AS (SELECT id, trim(unnest(regexp_extract_all(text, {CAP}, 1))) AS caption FROM md), w AS (SELECT unnest(string_split_regex(lower(caption), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM c) SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT 20")
def caption_keywords(spark, d):
    from stackroom.functions import text as T

    w = rendered(spark, d).select(F.explode(M.captions(F.col("text"))).alias("c")).select(F.explode(T.words(F.col("c"), 4)).alias("word"))
    return w.groupBy("word").agg(n()).orderBy(F.desc("n"), "word").limit(20)


@query(f"WITH {MD} SELECT id, (len(list_filter(regexp_extract_all(text, '(?i)(?:рис|fig)\\.?[ \\t]*(\\d+)', 1), lambda x: x = CAST(id % 9 AS STRING))) + len(list_filter(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x = CAST(id % 9 AS STRING))))::INT AS mentions FROM md")
def figure_mentions(spark, d):
    return rendered(spark, d).select("id", M.mentions(F.col("text"), F.col("id") % 9).alias("mentions"))


@query(f"WITH {MD}, x AS (SELECT id, lower(regexp_replace(unnest(regexp_extract_all(text, '10\\.\\d{{4,}}/[^\\s\\)\\]>]+')), '[.,;:]+$', '')) AS doi FROM md) SELECT doi, count(*) AS n, count(DISTINCT id) AS n_articles, regexp_full_match(doi, '10\\.\\d{{4,9}}/\\S+') AS valid, 'https://doi.org/' || doi AS url FROM x GROUP BY doi")
def doi_index(spark, d):
    x = rendered(spark, d).select("id", F.explode(M.dois(F.col("text"))).alias("doi"))
    return x.groupBy("doi").agg(n(), F.countDistinct("id").alias("n_articles")).withColumn("valid", M.valid_doi(F.col("doi"))).withColumn("url", F.concat(F.lit("https://doi.org/"), "doi"))


EXC = r"""ec AS (SELECT id, category, 'quote' AS kind, unnest(regexp_extract_all(text, '(?m)^>[ \t]*([^\r\n]{20,})', 1)) AS x FROM md UNION ALL SELECT id, category, 'bold', unnest(regexp_extract_all(text, '\*\*([^*\r\n]{20,})\*\*', 1)) FROM md
UNION ALL SELECT id, category, 'key_idea', unnest(regexp_extract_all(text, '(?i)((?:главное|важно|ключевая идея|key idea|important)[^.\r\n]*)', 1)) FROM md UNION ALL SELECT id, category, 'principle', unnest(regexp_extract_all(text, '(?i)((?:принцип|правило|principle|rule)[^.\r\n]{10,})', 1)) FROM md
UNION ALL SELECT id, category, 'definition', unnest(regexp_extract_all(text, '([^.\r\n]{3,} — это [^.\r\n]+)', 1)) FROM md UNION ALL SELECT id, category, 'example', unnest(regexp_extract_all(text, '(?i)((?:например|for example)[^.\r\n]+)', 1)) FROM md),
ex AS (SELECT id, category, kind, trim(x) AS text FROM ec)"""


def _excerpts(spark, d):
    return rendered(spark, d).select("id", "category", F.explode(M.excerpts(F.col("text"))).alias("e")).select("id", "category", "e.kind", "e.text")


@query(f"WITH {MD}, {EXC} SELECT left(md5(id || ':' || kind || ':' || text), 12) AS excerpt_id, id, kind, text FROM ex")
def excerpt_book(spark, d):
    return _excerpts(spark, d).select(F.substring(F.md5(F.concat_ws(":", "id", "kind", "text")), 1, 12).alias("excerpt_id"), "id", "kind", "text")


@query(f"WITH {MD}, {EXC} SELECT category, kind, count(*) AS n, max(length(text))::INT AS longest FROM ex GROUP BY ALL")
def excerpts_by_topic(spark, d):
    return _excerpts(spark, d).groupBy("category", "kind").agg(n(), F.max(F.length("text")).alias("longest"))


@query(f"WITH {MD}, {EXC}, s AS (SELECT id, kind, text, CASE kind WHEN 'definition' THEN 5 WHEN 'principle' THEN 4 WHEN 'key_idea' THEN 4 WHEN 'quote' THEN 3 ELSE 2 END + length(text) // 50 AS score FROM ex) SELECT id, kind, text, score::INT AS score FROM s ORDER BY score DESC, id, kind, text LIMIT 50")
def top_excerpts(spark, d):
    k = F.col("kind")
    score = F.when(k == "definition", 5).when(k.isin("principle", "key_idea"), 4).when(k == "quote", 3).otherwise(2) + F.floor(F.length("text") / 50)
    return _excerpts(spark, d).select("id", "kind", "text", score.cast("int").alias("score")).orderBy(F.desc("score"), "id", "kind", "text").limit(50)


@query(f"""WITH {MD}, {EXC}, lv AS (SELECT left(md5(id || ':' || kind || ':' || text), 12) AS excerpt_id, (id % 9)::INT AS level, modified FROM ex JOIN md m USING (id) WHERE m.modified IS NOT NULL), nx AS (SELECT excerpt_id, level, modified::DATE + ([1, 3, 7, 14, 30, 60, 120])[least(level, 6) + 1] AS due FROM lv) SELECT excerpt_id, level, strftime(due, '%Y-%m-%d') AS due, due <= DATE '2026-01-01' AS is_due FROM nx""".replace("text), 12) AS excerpt_id, (id", "ex.text), 12) AS excerpt_id, (id"))
def spaced_repetition(spark, d):
    """Day on which each excerpt comes up again, by its level, from the day its article changed."""
    days = F.array(*[F.lit(x) for x in (1, 3, 7, 14, 30, 60, 120)])
    e = _excerpts(spark, d).join(arts(spark, d).select("id", "modified"), "id").where("modified IS NOT NULL")
    e = e.select(F.substring(F.md5(F.concat_ws(":", "id", "kind", "text")), 1, 12).alias("excerpt_id"), (F.col("id") % 9).cast("int").alias("level"), F.to_date("modified").alias("day"))
    e = e.withColumn("due", F.date_add("day", F.element_at(days, F.least("level", F.lit(6)) + 1)))
    return e.select("excerpt_id", "level", F.date_format("due", "yyyy-MM-dd").alias("due"), (F.col("due") <= F.lit("2026-01-01").cast("date")).alias("is_due"))


REF = r"rf AS (SELECT id, 'note' AS kind, unnest(regexp_extract_all(text, '(?:^|\s)#(\d+)', 1)) AS target FROM md UNION ALL SELECT id, 'article', unnest(regexp_extract_all(text, '(?:^|\s)@([\w/.-]+\.md)', 1)) FROM md UNION ALL SELECT id, 'concept', unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) FROM md)"


def _references(spark, d):
    return rendered(spark, d).select("id", F.explode(M.references(F.col("text"))).alias("r")).select("id", "r.kind", F.col("r.text").alias("target"))


@query(f"WITH {MD}, {REF} SELECT kind, target, count(*) AS n, min(id) AS first_id FROM rf GROUP BY ALL")
def note_backlinks(spark, d):
    return _references(spark, d).groupBy("kind", "target").agg(n(), F.min("id").alias("first_id"))


@query(f"WITH {MD}, {REF}, h AS (SELECT DISTINCT id, target::BIGINT AS dst FROM rf WHERE kind = 'note') SELECT id FROM md WHERE id NOT IN (SELECT dst FROM h) AND id NOT IN (SELECT id FROM h JOIN (SELECT id AS dst FROM md) USING (dst))")
def orphaned_notes(spark, d):
    """Notes that no note names by number and that name none that exists."""
    ids = rendered(spark, d).select("id")
    h = _references(spark, d).where("kind = 'note'").select("id", F.col("target").cast("long").alias("dst")).distinct()
    named, naming = h.select(F.col("dst").alias("id")).distinct(), h.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("id").distinct()
    return ids.join(named, "id", "left_anti").join(naming, "id", "left_anti")


@query(f"""WITH {MD} SELECT id, len(regexp_extract_all(text, '(?:^|[^!])\\[[^\\]]+\\]\\([^)]+\\)'))::INT AS links, len(regexp_extract_all(text, 'https?://[^\\s)]+'))::INT AS addresses, (len(regexp_extract_all(text, '```')) // 2)::INT AS code_blocks, len(regexp_extract_all(text, {IMG}))::INT AS images, len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \\t]+\\S'))::INT AS headings FROM md""")
def content_metadata(spark, d):
    return rendered(spark, d).select("id", M.metadata_counts(F.col("text")).alias("m")).select("id", "m.*")


AUTH = """au AS (SELECT id, title, url, y, string_split_regex(trim('Anna ' || CASE WHEN id % 3 = 0 THEN 'Maria ' ELSE '' END || author), '\\s+') AS w FROM (SELECT id, coalesce(title, 'Untitled') AS title, author, 'https://kb.example/' || path AS url, coalesce(CAST(year(modified) AS STRING), 'n.d.') AS y FROM art)),
nm AS (SELECT *, w[len(w)] AS last, array_to_string(w[1:len(w) - 1], ' ') AS first, array_to_string(list_transform(w[1:len(w) - 1], lambda x: upper(x[1]) || '.'), ' ') AS ini FROM au)"""


@query(f"""WITH {ART}, {AUTH} SELECT id, rtrim(last || ', ' || ini || ' (' || y || '). ' || title || '. ' || coalesce(url, '')) AS apa, rtrim(last || ', ' || first || '. "' || title || '." ' || y || '. ' || coalesce(url, '')) AS mla, rtrim(last || ', ' || first || '. "' || title || '." Accessed ' || y || '. ' || coalesce(url, '')) AS chicago,
rtrim(last || ', ' || ini || ' ' || y || ', ''' || title || ''', available at: ' || coalesce(url, '')) AS harvard, rtrim('[' || id || '] ' || ini || ' ' || last || ', "' || title || '," ' || y || '. ' || coalesce(url, '')) AS ieee FROM nm""")
def citation_styles(spark, d):
    """Every article as an entry in five citation styles."""
    a = arts(spark, d)
    who = F.concat(F.lit("Anna "), F.when(F.col("id") % 3 == 0, "Maria ").otherwise(""), "author")
    url, year = F.concat(F.lit("https://kb.example/"), "path"), F.year("modified")
    return a.select("id", *[M.citation(s, who, F.col("title"), year, url, F.col("id")).alias(s) for s in ("apa", "mla", "chicago", "harvard", "ieee")])


@query(f"WITH {ART}, s AS (SELECT id, author, title, CASE WHEN id % 5 = 0 THEN NULL ELSE 'https://kb.example/' || category || '/' || (id % 200) END AS url FROM art), k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM s) SELECT id, author, title, url FROM k WHERE url IS NULL OR r = 1")
def master_bibliography(spark, d):
    """Sources without repeated addresses, the first of each kept; those without address all stay."""
    s = arts(spark, d).selectExpr("id", "author", "title", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'https://kb.example/' || category || '/' || CAST(id % 200 AS STRING) END AS url")
    first = s.where("url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct("id", "author", "title"), "id").alias("s"))
    return first.select("s.*", "url").unionByName(s.where("url IS NULL"))
