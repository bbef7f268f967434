"""Reader of a folder of Markdown, HTML and text files into the articles table."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?(.*)$"
#: Typed columns of the front matter; everything else goes to the map ``extra``.
STRINGS = ("title", "date", "category", "subcategory", "status", "difficulty", "author", "source", "source_url", "description", "dewey", "parent", "series", "importance")
LISTS = ("tags", "related", "prerequisites", "keywords")
SCHEMA = (
    "path string, fm_state string, " + ", ".join(f"{c} string" for c in STRINGS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS)
    + ", part int, milestone boolean, extra map<string,string>, body string"
)


def file_format(path: Column) -> Column:
    """md, html, txt or unknown, by suffix."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "md").when(ext.isin("html", "htm"), "html").when(ext == "txt", "txt").otherwise("unknown")


def files(spark: SparkSession, folder: str, exclude: str = r"(^|/)(\.git|node_modules)(/|$)|/INDEX\.md$") -> DataFrame:
    """(path, size, modified, md5, text): every file below the folder that no exclusion names.

    Spark's file sources list no files of zero bytes, so those have no row.
    """
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return b.where(~F.col("path").rlike(exclude)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"), F.col("content").cast("string").alias("text"))


def split_front_matter(text: Column) -> Column:
    """struct<front, body>; front is null where the text has none."""
    has = text.rlike(FRONT)
    return F.struct(F.when(has, F.regexp_extract(text, FRONT, 1)).alias("front"), F.when(has, F.regexp_extract(text, FRONT, 2)).otherwise(text).alias("body"))


def naive(front: str) -> dict:
    """``key: value`` lines; [a, b] and following ``- item`` lines are lists."""
    out: dict = {}
    last = None
    for line in front.splitlines():
        if m := re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line):
            if last is not None:
                if not isinstance(out.get(last), list):
                    out[last] = []
                out[last].append((m.group(1) or m.group(2) or "").strip().strip("\"'"))
        elif m := re.match(r"([\w-]+):\s*(.*)$", line):
            last, v = m.group(1), m.group(2).strip()
            if v.startswith("[") and v.endswith("]"):
                out[last] = [x.strip().strip("\"'") for x in v[1:-1].split(",") if x.strip()]
            else:
                out[last] = v.strip("\"'")
    return out


def parse_front(front: str, mode: str = "yaml") -> tuple[str, dict]:
    """(state, values). Takes YAML, a Python dict literal, or key: value lines; malformed text gives an empty dict."""
    text = front.strip()
    if text.startswith("{"):
        plain = re.sub(r"datetime\.date\((\d+),\s*(\d+),\s*(\d+)\)", lambda m: f"'{int(m[1]):04}-{int(m[2]):02}-{int(m[3]):02}'", text)
        try:
            v = ast.literal_eval(plain)
            return ("literal", v) if isinstance(v, dict) else ("malformed", {})
        except (ValueError, SyntaxError):
            return "malformed", {}
    if mode == "yaml":
        try:
            import yaml
        except ImportError:
            return "naive", naive(front)
        try:
            v = yaml.safe_load(front)
            return ("yaml", v) if isinstance(v, dict) else ("malformed", {})
        except yaml.YAMLError:
            return "malformed", {}
    return "naive", naive(front)


def _row(path: str, front: str | None, body: str, mode: str) -> dict:
    state, fm = ("none", {}) if front is None else parse_front(front, mode)
    out = {"path": path, "fm_state": state, "body": body}
    text = lambda v: None if v is None else str(v)
    for c in STRINGS:
        out[c] = text(fm.pop(c, None))
    for c in LISTS:
        v = fm.pop(c, None)
        out[c] = None if v is None else [str(x) for x in v if x is not None] if isinstance(v, list) else [s.strip() for s in str(v).split(",") if s.strip()]
    part = fm.pop("part", None)
    out["part"] = int(part) if str(part).isdigit() else None
    mark = fm.pop("milestone", None)
    out["milestone"] = None if mark is None else str(mark).lower() in ("true", "1", "yes")
    out["extra"] = {str(k): str(v) for k, v in fm.items()}
    return out


def articles(spark: SparkSession, folder: str, mode: str = "yaml") -> DataFrame:
    """Articles of a folder. Files without front matter are kept (fm_state none), malformed ones too."""
    f = files(spark, folder).where(file_format(F.col("path")) == "md")
    s = f.select("path", split_front_matter(F.coalesce("text", F.lit(""))).alias("s")).select("path", "s.front", "s.body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_row(p, f, t, mode) for p, f, t in zip(b["path"], b["front"], b["body"])]
            d = pd.DataFrame(rows)
            d["part"] = d["part"].astype("Int32")
            yield d

    return s.mapInPandas(run, SCHEMA)
