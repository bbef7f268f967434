"""Spark session factory and the shared-folder helpers that cut lineage."""

from __future__ import annotations

import atexit
import gzip
import io
import os
import pickle
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings every operator relies on; a cluster may set the rest as it likes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.checkpoint.compress": "true",
}


def get_spark(app: str = "stackroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless they can import it themselves.

    A Python worker starts with the PYTHONPATH of the application; where that names the folder
    of this package, nothing is sent.
    """
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in root.parts:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="stackroom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "stackroom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where that setting is absent - local tests - a temporary folder is made and
    removed at exit. A cluster session without the setting is refused: a folder of one
    machine is no place for data the other executors must read.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="stackroom-")
    atexit.register(shutil.rmtree, d, True)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: row order and partitions are kept, lineage ends here. Runs a job."""
    spark = df.sparkSession
    d = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """``cut`` and the number of rows that meet a condition, counted by the job that writes them."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as compressed columnar files in the shared folder and read them back.

    For intermediate results that several branches of a plan need: the branches then scan
    the table instead of computing it again, and pruned columns are not read at all. Runs a job;
    the files are removed by ``release`` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def pack(x: Any) -> bytes:
    """An object that an executor has built, for a broadcast: the driver passes on the bytes and never holds the object."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1) as f:
        pickle.dump(x, f, pickle.HIGHEST_PROTOCOL)
    return out.getvalue()


def unpack(held) -> Any:
    """The object whose packed bytes a broadcast holds; a Python worker keeps the last one."""
    data = held.value
    if not _held or _held[0] is not data:
        _held[:] = ()
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            _held[:] = data, pickle.load(f)
    return _held[1]


_held: list = []


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far, once their results are no longer needed; returns how many."""
    n = 0
    while _written:
        path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return n
    return n
