"""Column functions over text: tokens, n-grams, counts, readability, structure. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that separates words; the complement of letters, digits and the underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"
RU_EN_WORD = r"^[а-яёa-z]+$"
# Function words of both languages that searches leave out.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему "
    "the a an and or but in on at to for of with by from as is was are were be been this that each under after before without"
).split()


def words(text: Column, least: int = 1, letters_only: bool = False, stop_words: bool = False) -> Column:
    """Lower-case words in order. Null text gives an empty array."""
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD)
    keep = lambda x: (F.length(x) >= least) & (x.rlike(RU_EN_WORD) if letters_only else F.lit(True)) & (~x.isin(STOP_WORDS) if stop_words else F.lit(True))
    return F.filter(w, lambda x: (x != "") & keep(x))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array; shorter arrays have none."""
    gram = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
    return let(tokens, lambda t: F.when(F.size(t) >= n, gram(t)).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, k: int) -> Column:
    """Distinct character k-grams of the text."""
    gram = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i: F.substr(t, i, F.lit(k))))
    return let(text, lambda t: F.when(F.length(t) >= k, gram(t)).otherwise(F.array().cast("array<string>")))


def normalized(text: Column) -> Column:
    """White space collapsed, Markdown marks dropped, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[#*`_\[\]()]", ""), r"\s+", " ")))


def fingerprint(text: Column, algorithm: str = "md5") -> Column:
    """Digest of the normalised text."""
    n = normalized(text)
    return {"md5": F.md5(n), "sha1": F.sha1(n), "sha256": F.sha2(n, 256)}[algorithm]


def sentence_count(text: Column) -> Column:
    """Pieces between runs of . ! ? that hold more than white space."""
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))


def syllables_groups(word: Column) -> Column:
    """Groups of vowels, at least one."""
    return F.greatest(F.regexp_count(word, F.lit("[аеёиоуыэюяaeiouy]+")), F.lit(1))


def vowels(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[аеёиоуыэюяaeiouy]"))


def flesch(words_: Column, sentences: Column, syllables: Column) -> Column:
    return F.lit(206.835) - 1.015 * words_ / sentences - 84.6 * syllables / words_


def flesch_kincaid(words_: Column, sentences: Column, syllables: Column) -> Column:
    return 0.39 * words_ / sentences + 11.8 * syllables / words_ - 15.59


def coleman_liau(words_: Column, sentences: Column, chars: Column) -> Column:
    return 0.0588 * (chars / words_ * 100) - 0.296 * (sentences / words_ * 100) - 15.8


def ari(words_: Column, sentences: Column, chars: Column) -> Column:
    return 4.71 * chars / words_ + 0.5 * words_ / sentences - 21.43


def smog(sentences: Column, polysyllables: Column) -> Column:
    return 1.0430 * F.sqrt(polysyllables * 30 / sentences) + 3.1291


def gunning_fog(words_: Column, sentences: Column, complex_words: Column) -> Column:
    return 0.4 * (words_ / sentences + 100 * complex_words / words_)


def flesch_label(score: Column) -> Column:
    """Seven bands at 90, 80, 70, 60, 50 and 30."""
    out = F.when(score >= 90, "very_easy")
    for at, name in ((80, "easy"), (70, "fairly_easy"), (60, "standard"), (50, "fairly_difficult"), (30, "difficult")):
        out = out.when(score >= at, name)
    return out.otherwise("very_difficult")


def script(text: Column) -> Column:
    """RU where any Cyrillic letter stands, else EN where any Latin one does, else OTHER."""
    return F.when(text.rlike("[а-яА-ЯёЁ]"), "RU").when(text.rlike("[a-zA-Z]"), "EN").otherwise("OTHER")


def slug(text: Column) -> Column:
    """Heading anchor: lower, marks dropped, spaces to hyphens, runs collapsed."""
    s = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"-+", "-"), r"^-|-$", "")


def headings(text: Column) -> Column:
    """array<struct<level, title>> of ATX headings in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+[^\r\n]+)"), 1)
    return F.transform(lines, lambda l: F.struct(F.length(F.regexp_extract(l, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(l, r"^#+[ \t]+", "")).alias("title")))


def links(text: Column) -> Column:
    """array<struct<label, url>> of inline Markdown links, images left out."""
    p = r"(?:^|[^!])\[([^\]]+)\]\(([^)]+)\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("label"), F.regexp_extract_all(text, F.lit(p), 2).alias("url"))


def code_blocks(text: Column) -> Column:
    """array<struct<lang, code>> of fenced blocks."""
    p = r"(?s)```(\w*)[ \t]*\r?\n(.*?)```"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("lang"), F.regexp_extract_all(text, F.lit(p), 2).alias("code"))


def table_rows(text: Column) -> Column:
    """Lines that are rows of a pipe table."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^([ \t]*\|[^\r\n]*\|[ \t]*)\r?$"), 1)


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase, case ignored."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase.lower()), F.lit("")))) / len(phrase)).cast("int")


def reading_minutes(n_words: Column, wpm: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_words / wpm)).cast("int")
