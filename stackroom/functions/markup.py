"""What Markdown texts hold beside prose: figures, captions, references, DOIs, excerpts, citations. All in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r'!\[([^\]]*)\]\(([^)\s]+)(?:[ \t]+"([^"]*)")?\)'
CAPTION = r"(?m)^[*_]?(?:Рис|Рисунок|Fig|Figure|Таблица|Table)\.?[ \t]*\d+[.:]?[ \t]*([^\r\n*_]+)"
DOI = r"10\.\d{4,}/[^\s\)\]>]+"
#: (kind, pattern, group) of excerpts.
EXCERPTS = (
    ("quote", r"(?m)^>[ \t]*([^\r\n]{20,})", 1), ("bold", r"\*\*([^*\r\n]{20,})\*\*", 1), ("key_idea", r"(?iu)((?:главное|важно|ключевая идея|key idea|important)[^.\r\n]*)", 1),
    ("principle", r"(?iu)((?:принцип|правило|principle|rule)[^.\r\n]{10,})", 1), ("definition", r"([^.\r\n]{3,} — это [^.\r\n]+)", 1), ("example", r"(?iu)((?:например|for example)[^.\r\n]+)", 1),
)
#: (kind, pattern) of references between notes.
REFERENCES = (("note", r"(?:^|\s)#(\d+)"), ("article", r"(?:^|\s)@([\w/.-]+\.md)"), ("concept", r"\[\[([^\]]+)\]\]"))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def images(text: Column) -> Column:
    """array<struct<alt, url, title, embedded_bytes>>; embedded_bytes is the decoded size of a data address, else null."""
    parts = F.arrays_zip(_all(text, IMAGE, 1).alias("alt"), _all(text, IMAGE, 2).alias("url"), _all(text, IMAGE, 3).alias("title"))
    body = lambda u: F.regexp_extract(u, r"^data:[^,]*;base64,(.*)$", 1)
    size = lambda u: F.when(u.startswith("data:"), F.floor(F.length(F.regexp_replace(body(u), "=", "")) * 3 / 4).cast("int"))
    return F.transform(parts, lambda p: F.struct(p["alt"].alias("alt"), p["url"].alias("url"), p["title"].alias("title"), size(p["url"]).alias("embedded_bytes")))


def image_format(url: Column) -> Column:
    return F.when(url.startswith("data:"), F.regexp_extract(url, r"^data:image/(\w+)", 1)).otherwise(F.lower(F.regexp_extract(url, r"\.(\w+)(?:[?#].*)?$", 1)))


def alt_quality(alt: Column) -> Column:
    """0 for none; 40 for a text, 30 more from ten letters, 20 more up to 125, 10 more for several words."""
    n = F.length(F.trim(alt))
    return F.when(n == 0, 0).otherwise(40 + F.when(n >= 10, 30).otherwise(0) + F.when(n <= 125, 20).otherwise(0) + F.when(F.trim(alt).contains(" "), 10).otherwise(0))


def captions(text: Column) -> Column:
    return F.transform(_all(text, CAPTION, 1), lambda c: F.trim(c))


def mentions(text: Column, number: Column) -> Column:
    """How often a text names the figure of a number: рис. n, fig. n or [n]."""
    n = number.cast("string")
    count = lambda p: F.size(F.filter(_all(text, p, 1), lambda x: x == n))
    return count(r"(?iu)(?:рис|fig)\.?[ \t]*(\d+)") + count(r"\[(\d+)\]")


def dois(text: Column) -> Column:
    """DOIs without closing punctuation, in lower case as they compare."""
    return F.transform(_all(text, DOI), lambda x: F.lower(F.regexp_replace(x, r"[.,;:]+$", "")))


def valid_doi(doi: Column) -> Column:
    return F.coalesce(doi.rlike(r"^10\.\d{4,9}/\S+$"), F.lit(False))


def doi_of_url(url: Column) -> Column:
    d = F.regexp_extract(url, r"^https?://(?:dx\.)?doi\.org/(10\.\d{4,9}/\S+)$", 1)
    return F.when(d != "", d)


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("text"))


def excerpts(text: Column) -> Column:
    """array<struct<kind, text>> of quotes, bold passages, key ideas, principles, definitions and examples."""
    return F.concat(*[F.transform(_all(text, p, g), _tagged(k)) for k, p, g in EXCERPTS])


def references(text: Column) -> Column:
    """array<struct<kind, text>> of #notes, @articles and [[concepts]]."""
    return F.concat(*[F.transform(_all(text, p, 1), _tagged(k)) for k, p in REFERENCES])


def metadata_counts(text: Column) -> Column:
    """struct of the numbers of links, plain addresses, code blocks, images and headings."""
    n = lambda p: F.size(_all(text, p))
    return F.struct(
        n(r"(?:^|[^!])\[[^\]]+\]\([^)]+\)").alias("links"), n(r"https?://[^\s)]+").alias("addresses"), F.floor(n("```") / 2).cast("int").alias("code_blocks"), n(IMAGE).alias("images"), n(r"(?m)^#{1,6}[ \t]+\S").alias("headings"),
    )


# citations: author, title, date and the whole entry by style

INITIALS = r"(?:^|[\s-])(\p{L})"


def author_name(author: Column, style: str) -> Column:
    """'Last, F.' (apa, harvard), 'Last, First' (mla, chicago) or 'F. Last' (ieee) of 'First Last'; one word stays as it is."""
    words = F.split(F.trim(author), r"\s+")
    last, first = F.element_at(words, -1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    initials = F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    made = {"apa": F.concat(last, F.lit(", "), initials), "harvard": F.concat(last, F.lit(", "), initials), "mla": F.concat(last, F.lit(", "), first), "chicago": F.concat(last, F.lit(", "), first), "ieee": F.concat(initials, F.lit(" "), last)}
    return F.when(F.size(words) < 2, F.trim(author)).otherwise(made[style])


def citation(style: str, author: Column, title: Column, year: Column, url: Column, number: Column | None = None) -> Column:
    """One bibliography entry; null author and year are 'Unknown' and 'n.d.'."""
    a, y, t = author_name(F.coalesce(author, F.lit("Unknown")), style), F.coalesce(year.cast("string"), F.lit("n.d.")), F.coalesce(title, F.lit("Untitled"))
    lit = F.lit
    parts = {
        "apa": (a, lit(" ("), y, lit("). "), t, lit(". ")), "mla": (a, lit('. "'), t, lit('." '), y, lit(". ")), "chicago": (a, lit('. "'), t, lit('." Accessed '), y, lit(". ")),
        "harvard": (a, lit(" "), y, lit(", '"), t, lit("', available at: ")), "ieee": (lit("["), F.coalesce(number.cast("string") if number is not None else lit("1"), lit("1")), lit("] "), a, lit(', "'), t, lit('," '), y, lit(". ")),
    }[style]
    return F.rtrim(F.concat(*parts, F.coalesce(url, lit(""))))
