"""Session set-up, table loading and materialised intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes (of values, before the overhead of a hash table) and rows up to which a measured side of a join may be broadcast.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 400_000

_ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where it isn't installed."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, measured: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, later readers know its size, lost executors cost nothing.

    measured: its rows and bytes are observed while it is written, so that weight() and small() need no job of their own.
    The files are deleted when the driver ends, or by released().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    seen = Observation() if measured else None
    (df.observe(seen, *_measures(df)) if seen else df).write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    if seen:
        got = seen.get
        out._graphloom_weight = (got["rows"], got["bytes"] or 0)
    return out


#: Folders of intermediate results that are still there, by path.
_WRITTEN: dict[str, SparkSession] = {}


@contextmanager
def released() -> Iterator[None]:
    """Within it intermediate results are kept; at its end all written since its begin are deleted. For long sessions:
    whatever reads them must be done by then."""
    known = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - known:
            _delete(_WRITTEN.pop(path), path)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        _delete(spark, path)


def _measures(df: DataFrame) -> tuple[Column, Column]:
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
        elif kind.typeName() in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))).cast("long"), F.lit(0))
        total = total + 8
    return F.count(F.lit(1)).alias("rows"), F.sum(total).alias("bytes")


def weight(written: DataFrame) -> tuple[int, int]:
    """(rows, bytes of values) of a written result: strings, binaries and what arrays hold by their length, 8 more each."""
    known = getattr(written, "_graphloom_weight", None)
    if known is None:
        rows, n_bytes = written.agg(*_measures(written)).first()
        known = (rows, n_bytes or 0)
    return known


def small(written: DataFrame) -> bool:
    """Whether a written result is small enough to be broadcast."""
    rows, n_bytes = weight(written)
    return rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES


def hinted(written: DataFrame) -> DataFrame:
    """A written result, marked to be broadcast if its measured size allows it."""
    return F.broadcast(written) if small(written) else written


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


#: Bytes of a partition that costly work in Python gets, as the plan estimates them.
PART_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df in partitions for work that costs far more than a shuffle: as it is where it has two partitions per core, else (a
    few files or row groups) shuffled evenly into three per core, or more where its estimated size asks for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # rows that come from no file have no estimate, which Spark gives as a number beyond all sizes
    return df.repartition(max(3 * cores, size // PART_BYTES if size < 1 << 60 else 0))
