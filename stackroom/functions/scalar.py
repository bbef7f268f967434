"""Scalar function library: strings, numbers, dates, codes, checks - as Column builders.

``register(spark)`` makes each of them a SQL function of the session (``CREATE TEMPORARY
FUNCTION`` over plain expressions, no Python at run time). Nulls give null; what a function
cannot answer (division by zero, a wrong length) is null as well.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.text import let

# The Morse alphabet.
MORSE = {
    "a": ".-", "b": "-...", "c": "-.-.", "d": "-..", "e": ".", "f": "..-.", "g": "--.", "h": "....", "i": "..", "j": ".---", "k": "-.-", "l": ".-..", "m": "--",
    "n": "-.", "o": "---", "p": ".--.", "q": "--.-", "r": ".-.", "s": "...", "t": "-", "u": "..-", "v": "...-", "w": ".--", "x": "-..-", "y": "-.--", "z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
}
# Roman numerals in falling order.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
# Metres and kilograms per unit.
LENGTH = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
WEIGHT = {"mg": 0.000001, "g": 0.001, "kg": 1.0, "lb": 0.453592, "oz": 0.0283495}
LOWER = "abcdefghijklmnopqrstuvwxyz"


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


# strings


def reverse(s: Column) -> Column:
    return F.reverse(s)


def title_case(s: Column) -> Column:
    return F.initcap(s)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def slug(s: Column) -> Column:
    """ASCII slug."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def acronym(s: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def is_palindrome(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")
    return plain == F.reverse(plain)


def sorted_letters(s: Column) -> Column:
    return F.array_join(F.sort_array(chars(F.lower(F.regexp_replace(s, r"\s", "")))), "")


def is_anagram(a: Column, b: Column) -> Column:
    return sorted_letters(a) == sorted_letters(b)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal letters at equal places of the longer text; both empty give 1."""
    most = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.arrays_zip(chars(a).alias("x"), chars(b).alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(most == 0, 1.0).otherwise(same / most)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of texts of one length, else null."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.arrays_zip(chars(a).alias("x"), chars(b).alias("y")), lambda p: p["x"] != p["y"])))


def rot13(s: Column) -> Column:
    turned = LOWER[13:] + LOWER[:13]
    return F.translate(s, LOWER + LOWER.upper(), turned + turned.upper())


def atbash(s: Column) -> Column:
    return F.translate(s, LOWER + LOWER.upper(), LOWER[::-1] + LOWER[::-1].upper())


def morse(s: Column) -> Column:
    """Letters and digits in Morse, words parted by a slash; other signs are left out."""
    table = F.create_map(*[F.lit(x) for kv in {**MORSE, " ": "/"}.items() for x in kv])
    return F.array_join(F.filter(F.transform(chars(F.lower(s)), lambda c: table[c]), lambda c: c.isNotNull()), " ")


def unmorse(s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in {**MORSE, " ": "/"}.items() for x in (v, k)])
    return F.array_join(F.filter(F.transform(F.split(s, " "), lambda c: table[c]), lambda c: c.isNotNull()), "")


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_unescape(s: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def distinct_lines(s: Column, fold_case: bool = False) -> Column:
    """Lines without later repeats, order kept."""
    lines = F.split(s, "\n")
    if not fold_case:
        return F.array_join(F.array_distinct(lines), "\n")
    return F.array_join(let(lines, lambda l: F.filter(l, lambda x, i: F.array_position(F.transform(l, F.lower), F.lower(x)) == i + 1)), "\n")


def line_diff(a: Column, b: Column) -> Column:
    """struct<added, removed, common> counts of distinct lines."""
    x, y = F.array_distinct(F.split(a, "\n")), F.array_distinct(F.split(b, "\n"))
    return F.struct(F.size(F.array_except(y, x)).alias("added"), F.size(F.array_except(x, y)).alias("removed"), F.size(F.array_intersect(x, y)).alias("common"))


def char_entropy(s: Column) -> Column:
    """Shannon entropy of the letters in bits; empty text has 0."""
    return let(chars(s), lambda c: F.when(F.size(c) == 0, 0.0).otherwise(
        -F.aggregate(F.array_distinct(c), F.lit(0.0), lambda acc, x: acc + let(F.size(F.filter(c, lambda y: y == x)) / F.size(c), lambda p: p * F.log2(p)))
    ))


# Words that speak for and against, as parts of the text.
GOOD = ("good", "great", "excellent", "love", "happy", "best", "хорош", "отличн", "добр", "вкусн", "удобн")
BAD = ("bad", "terrible", "hate", "worst", "sad", "awful", "плох", "ужасн", "груст", "хуже")


def sentiment(s: Column) -> Column:
    """Score from 0 to 1: .5 neutral, .6 and .4 moved by .1 for each hit more on one side."""
    low = F.lower(s)
    hits = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    d = hits(GOOD) - hits(BAD)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(d > 0, 0.6 + 0.1 * (d - 1)).when(d < 0, 0.4 + 0.1 * (d + 1)).otherwise(0.5)))


# codes and checks


def is_email(s: Column) -> Column:
    return s.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def is_ipv4(s: Column) -> Column:
    part = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return s.rlike(rf"^{part}(\.{part}){{3}}$")


def is_url(s: Column) -> Column:
    return s.rlike(r"^https?://[^\s/$.?#][^\s]*$")


def is_card(s: Column) -> Column:
    """Luhn check of the digits; 13 to 19 of them."""
    d = F.regexp_replace(s, r"[\s-]", "")
    return d.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", d)


def format_phone(s: Column) -> Column:
    """Eleven digits from 7 or 8 the Russian way, ten the American way, others as they are."""
    d = F.regexp_replace(s, r"\D", "")
    ru = F.regexp_replace(d, r"^[78](\d{3})(\d{3})(\d{2})(\d{2})$", "+7 ($1) $2-$3-$4")
    us = F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    return F.when(d.rlike(r"^[78]\d{10}$"), ru).when(d.rlike(r"^\d{10}$"), us).otherwise(s)


def hex_to_rgb(s: Column) -> Column:
    h = F.regexp_replace(s, "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def parse_url(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


# numbers


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part * 100.0 / whole)


def to_base(n: Column, base: int) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, base))


def roman(n: Column) -> Column:
    """1 to 3999, else null."""
    n = n.cast("int")
    text, rest = F.lit(""), n
    for v, r in ROMAN:
        text = F.concat(text, F.repeat(F.lit(r), F.floor(rest / v).cast("int")))
        rest = rest % v
    return F.when(n.between(1, 3999), text)


def unroman(s: Column) -> Column:
    value = F.create_map(*[F.lit(x) for v, r in ROMAN if len(r) == 1 for x in (r, v)])
    v = F.transform(chars(F.upper(s)), lambda c: value[c])
    return let(v, lambda a: F.aggregate(F.transform(a, lambda x, i: F.when(x < F.coalesce(F.try_element_at(a, i + 2), F.lit(0)), -x).otherwise(x)), F.lit(0), lambda t, x: t + x))


def fibonacci(n: Column) -> Column:
    """The first n numbers of the series, at most 90 of them fit."""
    step = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(90)).cast("int")), F.array().cast("array<bigint>"), lambda a, i: F.concat(a, F.array(F.when(i <= 2, (i - 1).cast("long")).otherwise(F.try_element_at(a, i - 1) + F.try_element_at(a, i - 2)))))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(step)


def is_prime(n: Column) -> Column:
    """Trial division; n up to 10^12 or so is sensible."""
    n = n.cast("long")
    roots = F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n)), F.lit(2)).cast("long"))
    return F.when(n < 2, False).when(n < 4, True).otherwise(~F.exists(roots, lambda i: n % i == 0))


def gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 90 steps, enough for 64 bits."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y")), lambda p, _: F.struct(F.when(p["y"] == 0, p["x"]).otherwise(p["y"]).alias("x"), F.when(p["y"] == 0, F.lit(0).cast("long")).otherwise(p["x"] % p["y"]).alias("y")))
    return pair["x"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a.cast("long") / gcd(a, b)) * F.abs(b)).cast("long"))


def factorial(n: Column) -> Column:
    """Up to 20 as a whole number, else null."""
    return F.factorial(n.cast("int"))


def circle(r: Column) -> Column:
    return F.struct((F.pi() * r * r).alias("area"), (2 * F.pi() * r).alias("circumference"), (2 * r).alias("diameter"))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Heron; null where the sides make no triangle."""
    s = (a + b + c) / 2
    return F.when((a + b > c) & (a + c > b) & (b + c > a), F.sqrt(s * (s - a) * (s - b) * (s - c)))


def convert(v: Column, of: str, to: str) -> Column:
    """Length, weight or temperature (c, f, k)."""
    for table in (LENGTH, WEIGHT):
        if of in table and to in table:
            return v * table[of] / table[to]
    celsius = {"c": v, "f": (v - 32) * 5 / 9, "k": v - 273.15}[of]
    return {"c": celsius, "f": celsius * 9 / 5 + 32, "k": celsius + 273.15}[to]


def file_size(n: Column) -> Column:
    """Bytes in steps of 1024 with two decimals."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    text = lambda i: F.concat(F.format_string("%.2f", n.cast("double") / 1024**i), F.lit(" " + units[i]))
    out = F.when(n >= 1024**5, text(5))
    for i in (4, 3, 2, 1):
        out = out.when(n >= 1024**i, text(i))
    return out.when(n.isNotNull(), text(0))


# dates, arrays


def add_days(d: Column, n: Column) -> Column:
    return F.date_format(F.date_add(F.to_date(d), n), "yyyy-MM-dd")


def epoch_to_text(s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a))


def array_median(a: Column) -> Column:
    return let(F.sort_array(a), lambda s: F.when(F.size(s) == 0, None).when(F.size(s) % 2 == 1, F.element_at(s, (F.size(s) / 2).cast("int") + 1).cast("double")).otherwise((F.try_element_at(s, (F.size(s) / 2).cast("int")) + F.try_element_at(s, (F.size(s) / 2).cast("int") + 1)) / 2.0))


def array_variance(a: Column) -> Column:
    """Population variance."""
    return let(array_mean(a), lambda m: array_mean(F.transform(a, lambda x: (x - m) * (x - m))))


def array_outliers(a: Column) -> Column:
    """Values beyond 1.5 interquartile ranges, quartiles by position; none below four values."""
    n = F.size(a)
    q = lambda s, k: F.try_element_at(s, F.floor(n * k / 4).cast("int") + 1)
    return let(F.sort_array(a), lambda s: F.when(n < 4, F.slice(a, 1, 0)).otherwise(F.filter(a, lambda x: (x < q(s, 1) - 1.5 * (q(s, 3) - q(s, 1))) | (x > q(s, 3) + 1.5 * (q(s, 3) - q(s, 1))))))


def clean_array(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != ""))


#: name -> (builder, parameter types) of what ``register`` makes callable from SQL.
SQL_FUNCTIONS = {
    "sr_capitalize": (capitalize, ["string"]), "sr_slug": (slug, ["string"]), "sr_acronym": (acronym, ["string"]), "sr_is_palindrome": (is_palindrome, ["string"]),
    "sr_is_anagram": (is_anagram, ["string", "string"]), "sr_positional_similarity": (positional_similarity, ["string", "string"]), "sr_levenshtein_similarity": (levenshtein_similarity, ["string", "string"]),
    "sr_hamming": (hamming, ["string", "string"]), "sr_rot13": (rot13, ["string"]), "sr_atbash": (atbash, ["string"]), "sr_is_email": (is_email, ["string"]), "sr_is_ipv4": (is_ipv4, ["string"]),
    "sr_is_url": (is_url, ["string"]), "sr_is_card": (is_card, ["string"]), "sr_format_phone": (format_phone, ["string"]), "sr_html_escape": (html_escape, ["string"]), "sr_html_unescape": (html_unescape, ["string"]),
    "sr_percentage": (percentage, ["double", "double"]), "sr_roman": (roman, ["int"]), "sr_is_prime": (is_prime, ["bigint"]), "sr_gcd": (gcd, ["bigint", "bigint"]), "sr_factorial": (factorial, ["int"]),
    "sr_triangle_area": (triangle_area, ["double", "double", "double"]), "sr_array_mean": (array_mean, ["array<double>"]), "sr_array_median": (array_median, ["array<double>"]), "sr_array_variance": (array_variance, ["array<double>"]),
}


#: SQL bodies of the functions with lambdas, which Spark does not print in a form it can read.
LAMBDA_SQL = {
    "sr_acronym": "array_join(transform(filter(split(a0, '\\\\s+'), w -> w <> ''), w -> upper(left(w, 1))), '')",
    "sr_is_anagram": "array_sort(filter(split(lower(regexp_replace(a0, '\\\\s', '')), ''), c -> c <> '')) = array_sort(filter(split(lower(regexp_replace(a1, '\\\\s', '')), ''), c -> c <> ''))",
    "sr_positional_similarity": "CASE WHEN greatest(length(a0), length(a1)) = 0 THEN 1D ELSE size(filter(sequence(1, greatest(least(length(a0), length(a1)), 1)), i -> substring(a0, i, 1) <> '' AND substring(a0, i, 1) = substring(a1, i, 1))) / greatest(length(a0), length(a1)) END",
    "sr_hamming": "CASE WHEN length(a0) = length(a1) THEN size(filter(sequence(1, greatest(length(a0), 1)), i -> substring(a0, i, 1) <> substring(a1, i, 1))) END",
    "sr_is_prime": "CASE WHEN a0 < 2 THEN false WHEN a0 < 4 THEN true ELSE NOT exists(sequence(2L, CAST(floor(sqrt(a0)) AS BIGINT)), i -> a0 % i = 0) END",
    "sr_gcd": "aggregate(sequence(1, 90), named_struct('x', abs(a0), 'y', abs(a1)), (p, i) -> named_struct('x', CASE WHEN p.y = 0 THEN p.x ELSE p.y END, 'y', CASE WHEN p.y = 0 THEN 0L ELSE p.x % p.y END), p -> p.x)",
    "sr_array_mean": "CASE WHEN size(a0) > 0 THEN aggregate(a0, 0D, (t, x) -> t + x) / size(a0) END",
    "sr_array_median": "transform(array(sort_array(a0)), s -> CASE WHEN size(s) = 0 THEN NULL WHEN size(s) % 2 = 1 THEN element_at(s, int(size(s) / 2) + 1) ELSE (element_at(s, int(size(s) / 2)) + element_at(s, int(size(s) / 2) + 1)) / 2 END)[0]",
    "sr_array_variance": "transform(array(aggregate(a0, 0D, (t, x) -> t + x) / nullif(size(a0), 0)), m -> aggregate(a0, 0D, (t, x) -> t + (x - m) * (x - m)) / nullif(size(a0), 0))[0]",
}


def register(spark: SparkSession) -> list[str]:
    """Make the library callable from SQL as temporary functions; returns their names."""
    for name, (build, types) in SQL_FUNCTIONS.items():
        args = [f"a{i}" for i in range(len(types))]
        body = LAMBDA_SQL.get(name)
        if body is None:
            df = spark.range(0).select(*[F.lit(None).cast(t).alias(a) for a, t in zip(args, types)]).select(build(*map(F.col, args)))
            body = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {t}' for a, t in zip(args, types))}) RETURN {body}")
    return list(SQL_FUNCTIONS)
