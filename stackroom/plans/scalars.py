"""Queries that hold the scalar library against SQL over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import scalar as X
from stackroom.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, reverse(p_name) AS reversed, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capitalized, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
array_to_string(list_transform(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1))), '') AS acronym FROM part""")
def strings_case(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.reverse(n).alias("reversed"), X.capitalize(n).alias("capitalized"), X.slug(n).alias("slug"), X.acronym(n).alias("acronym"))


@query("""SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot13,
translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA') AS atbash, to_base64(encode(p_name)) AS base64, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256 FROM part""")
def strings_codes(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.rot13(n).alias("rot13"), X.atbash(n).alias("atbash"), F.base64(n).alias("base64"), F.md5(n).alias("md5"), F.sha1(n).alias("sha1"), F.sha2(n, 256).alias("sha256"))


@query("""SELECT p_partkey, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END, 6) AS levenshtein_similarity,
round(len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[i] = p_type[i])) / greatest(length(p_name), length(p_type)), 6) AS positional,
CASE WHEN length(p_brand) = length(p_type) THEN hamming(p_brand, p_type) ELSE -1 END AS hamming FROM part""")
def strings_similarity(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.round(X.levenshtein_similarity(a, b), 6).alias("levenshtein_similarity"), F.round(X.positional_similarity(a, b), 6).alias("positional"), F.coalesce(X.hamming(F.col("p_brand"), b), F.lit(-1)).alias("hamming")
    )


@query("""SELECT change_id, email, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS valid FROM (SELECT DISTINCT change_id, email FROM recent_changes WHERE email IS NOT NULL)""")
def email_validator(spark, d):
    e = table(spark, d, "recent_changes").select("change_id", "email").where("email IS NOT NULL").distinct()
    return e.withColumn("valid", X.is_email(F.col("email")))


@query("""WITH n AS (SELECT o_orderkey AS k, (o_orderkey % 3999 + 1)::INT AS n FROM orders) SELECT k, n, bin(n) AS binary, lower(hex(n)) AS hexadecimal, n % 7 AS modulo, gcd(n, 360) AS gcd, lcm(n, 12) AS lcm FROM n""")
def numbers_bases(spark, d):
    n = F.col("n")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3999 + 1).cast("int").alias("n"))
    return o.select("k", "n", X.to_base(n, 2).alias("binary"), X.to_base(n, 16).alias("hexadecimal"), (n % 7).alias("modulo"), X.gcd(n, F.lit(360)).alias("gcd"), X.lcm(n, F.lit(12)).alias("lcm"))


@query("""WITH n AS (SELECT DISTINCT (p_size * 79 % 3999 + 1)::INT AS n FROM part) SELECT n, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1]
|| ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman, n AS back FROM n""")
def roman_numerals(spark, d):
    n = table(spark, d, "part").select((F.col("p_size") * 79 % 3999 + 1).cast("int").alias("n")).distinct()
    return n.withColumn("roman", X.roman(F.col("n"))).withColumn("back", X.unroman(F.col("roman")))


@query("""WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) SELECT n, n > 1 AND len(list_filter(range(2, n), lambda i: n % i = 0)) = 0 AS prime, CASE WHEN n <= 20 THEN factorial(n::INT)::BIGINT ELSE -1 END AS factorial FROM n""")
def number_theory(spark, d):
    n = table(spark, d, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", X.is_prime(F.col("n")).alias("prime"), F.coalesce(X.factorial(F.col("n")), F.lit(-1)).alias("factorial"))


@query("""SELECT p_partkey, round(p_retailprice * 100 / 2500, 6) AS pct, round(p_size * 0.3048::DOUBLE, 6) AS feet_in_m, round(p_size * 0.453592::DOUBLE, 6) AS pounds_in_kg, round((p_size - 32) * 5 / 9, 6) AS celsius,
round(pi() * p_size * p_size, 4) AS circle, round(CASE WHEN p_size > 0 THEN sqrt(3) / 4 * p_size * p_size END, 4) AS triangle FROM part""")
def units_geometry(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(X.percentage(F.col("p_retailprice"), F.lit(2500)), 6).alias("pct"), F.round(X.convert(s, "ft", "m"), 6).alias("feet_in_m"), F.round(X.convert(s, "lb", "kg"), 6).alias("pounds_in_kg"),
        F.round(X.convert(s, "f", "c"), 6).alias("celsius"), F.round(X.circle(s)["area"], 4).alias("circle"), F.round(X.triangle_area(s, s, s), 4).alias("triangle"),
    )


@query("""SELECT o_orderkey, strftime((o_orderdate::DATE + 30), '%Y-%m-%d') AS plus30, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days_to, strftime(o_orderdate::DATE, '%Y-%m') AS month FROM orders""")
def date_calculator(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", X.add_days(F.col("o_orderdate"), F.lit(30)).alias("plus30"), F.datediff(F.lit("2000-01-01").cast("date"), day).alias("days_to"), F.date_format(day, "yyyy-MM").alias("month"))


URL = "SELECT report_id, unnest(cross_references.broken_links).link.url AS u FROM toc_validation_report"


@query(f"""WITH l AS (SELECT DISTINCT u FROM ({URL}) WHERE u IS NOT NULL AND contains(u, '://')) SELECT u AS url, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(u, '^[^:]+://([^/?#]*)', 1) AS host,
regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\\?([^#]*)', 1) AS query FROM l""")
def url_parser(spark, d):
    l = table(spark, d, "toc_validation_report").select(F.explode("cross_references.broken_links").alias("b")).select(F.col("b.link.url").alias("url")).where("url IS NOT NULL AND contains(url, '://')").distinct()
    p = l.withColumn("p", X.parse_url(F.col("url")))
    return p.select("url", "p.scheme", "p.host", "p.path", "p.query")


@query("""SELECT vec_id, round(list_avg(e), 5) AS mean, round(list_median(e), 5) AS median, round(list_var_pop(e), 5) AS variance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def array_statistics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", *[F.round(f(F.col("e")), 5).alias(n) for n, f in (("mean", X.array_mean), ("median", X.array_median), ("variance", X.array_variance))])


@query("""SELECT vec_id, len(list_filter(e, lambda x: x < s[n // 4 + 1] - 1.5::DOUBLE * (s[3 * n // 4 + 1] - s[n // 4 + 1]) OR x > s[3 * n // 4 + 1] + 1.5::DOUBLE * (s[3 * n // 4 + 1] - s[n // 4 + 1])))::INT AS n_outliers
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_sort(embedding::DOUBLE[]) AS s, len(embedding) AS n FROM embeddings)""")
def array_outliers(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.size(X.array_outliers(F.col("e"))).alias("n_outliers"))


@query("""SELECT id, CASE WHEN n < 1024 THEN printf('%.2f', n) || ' B' WHEN n < 1048576 THEN printf('%.2f', n / 1024) || ' KB' ELSE printf('%.2f', n / 1048576) || ' MB' END AS size FROM (SELECT doc_id AS id, n_chars::DOUBLE * 3.7::DOUBLE AS n FROM documents)""")
def file_sizes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.file_size(F.col("n_chars").cast("double") * 3.7).alias("size"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def html_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", X.html_escape(F.col("text")).alias("escaped"))


@query("""WITH w AS (SELECT DISTINCT p_brand AS b FROM part) SELECT b, CASE WHEN length(b) > 0 THEN lower(b) = reverse(lower(b)) END AS palindrome, array_to_string(list_sort(list_filter(string_split(lower(b), ''), lambda c: c <> ' ')), '') AS letters FROM w""")
def palindrome_anagram(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("b")).distinct()
    return b.select("b", (F.lower("b") == F.reverse(F.lower("b"))).alias("palindrome"), X.sorted_letters(F.col("b")).alias("letters"))


@query("""SELECT c_custkey, '#' || lower(printf('%02x%02x%02x', c_custkey % 256, c_custkey * 7 % 256, c_nationkey % 256)) AS color FROM customer""")
def color_converter(spark, d):
    k, nn = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", X.rgb_to_hex(k % 256, k * 7 % 256, nn % 256).alias("color"))


@query()
def text_codes(spark, d):
    """Morse there and back, entropy and sentiment of article titles; tested against Python."""
    t = table(spark, d, "tagging_suggestions").select("suggestion_id", "title").where("title IS NOT NULL").distinct()
    return t.select("suggestion_id", X.morse(F.col("title")).alias("morse"), F.round(X.char_entropy(F.col("title")), 6).alias("entropy"), F.round(X.sentiment(F.col("title")), 3).alias("sentiment"))


@query()
def sql_function_surface(spark, d):
    """Names of the functions that are callable from SQL."""
    return spark.createDataFrame([(x,) for x in sorted(X.register(spark))], "name string")
