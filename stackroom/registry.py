"""Registry of the queries: what there is, what it does, and running one by name."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words in a name by which its category is told; the first group that matches counts.
CATEGORIES = (
    ("graph", ("graph", "link", "rank", "degree", "component", "cit", "path", "topolog", "cluster")), ("search", ("search", "bm25", "boolean", "phrase", "kwic", "fuzzy", "posting", "index")),
    ("quality", ("quality", "issue", "valid", "grade", "score", "readab")), ("tags", ("tag", "taxonomy", "thesaurus", "term")), ("time", ("stream", "month", "hour", "streak", "session", "commit", "activity", "veloc")),
    ("similarity", ("simil", "dup", "near", "related")), ("statistics", ("stat", "count", "distribution", "outlier", "correlation")),
)
STATES = {"pending": {"queued", "cancelled"}, "queued": {"running", "cancelled"}, "running": {"completed", "failed", "cancelled"}, "completed": set(), "failed": set(), "cancelled": set()}


def category(name: str) -> str:
    return next((c for c, keys in CATEGORIES if any(k in name for k in keys)), "other")


def complexity(n_lines: int | None) -> str:
    return "unknown" if n_lines is None else "simple" if n_lines < 15 else "medium" if n_lines < 40 else "complex"


def seconds(name: str) -> int:
    """Seconds a query is expected to take, by words in its name."""
    # Words and seconds.
    for keys, s in ((("graph", "network"), 30), (("index", "search"), 20), (("analy", "calculate"), 15)):
        if any(k in name for k in keys):
            return s
    return 10


def outputs(source: str) -> list[str]:
    """Formats a source text names as what it writes, in the order of their names."""
    return [k for k in ("csv", "dot", "html", "json", "latex", "parquet", "xml") if f"write_{k}" in source or f".{k}" in source]


def tags(name: str, description: str) -> list[str]:
    """Words of name and description that tell a query's subject, each once."""
    known = {k for _, keys in CATEGORIES for k in keys}
    found = [w for w in name.lower().split("_") + description.lower().split() if any(w.startswith(k) for k in known)]
    return list(dict.fromkeys(found))


def registry(spark: SparkSession, queries: dict[str, Callable]) -> DataFrame:
    """(name, category, module, description, n_lines, complexity, seconds, outputs, tags) of every query."""
    rows = []
    for name, f in sorted(queries.items()):
        try:
            source = inspect.getsource(f)
            n = len(source.splitlines())
        except OSError:
            source, n = "", None
        about = (inspect.getdoc(f) or "").split("\n")[0]
        rows.append((name, category(name), f.__module__, about, n, complexity(n), seconds(name), outputs(source), tags(name, about)))
    return spark.createDataFrame(
        rows, "name string, category string, module string, description string, n_lines int, complexity string, seconds int, outputs array<string>, tags array<string>"
    )


def search(reg: DataFrame, text: str) -> DataFrame:
    t = text.lower()
    return reg.where(F.lower("name").contains(t) | F.lower("description").contains(t) | F.col("category").contains(t))


@dataclass
class Job:
    """A run of a query: status changes follow STATES, times and the error are kept."""

    name: str
    status: str = "pending"
    times: dict = field(default_factory=dict)
    error: str | None = None
    rows: int | None = None

    def to(self, status: str) -> None:
        if status not in STATES[self.status]:
            raise ValueError(f"a {self.status} job cannot become {status}")
        self.status, self.times[status] = status, time.time()


def run(spark: SparkSession, queries: dict[str, Callable], name: str, sf_dir: str, path: str | None = None) -> Job:
    """Run a query by name, write its result to path if given, and return the finished job."""
    job = Job(name)
    job.to("queued")
    job.to("running")
    try:
        df = queries[name](spark, sf_dir)
        if path:
            df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
        job.rows = df.count()
        job.to("completed")
    except Exception as e:  # the job keeps what went wrong
        job.error = str(e)[:500]
        job.to("failed")
    return job


def retry_order(jobs: list[tuple[int, float, int]], most: int = 3) -> list[tuple[int, float]]:
    """Indices of jobs to run next by priority and age, with the seconds to wait before each.

    jobs: (priority, created, failures so far); jobs that failed ``most`` times are left out.
    The wait doubles from two seconds.
    """
    left = [(i, j) for i, j in enumerate(jobs) if j[2] < most]
    return [(i, 2.0 * 2 ** (j[2] - 1) if j[2] else 0.0) for i, j in sorted(left, key=lambda x: (-x[1][0], x[1][1]))]
