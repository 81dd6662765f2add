"""Session helpers: reading tables, spreading small scans, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skillmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of every executor, once for each session."""
    sc = spark.sparkContext
    if not getattr(sc, "_skillmill_shipped", False):
        root = Path(__file__).resolve().parent
        # in the shared folder where the cluster names one that is mounted; Spark serves the file to the executors
        shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        base = shared if shared.startswith("/") and os.path.isdir(shared) else None
        to = Path(tempfile.mkdtemp(prefix="skillmill-", dir=base)) / "skillmill.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        sc._skillmill_shipped = True
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of ``sf_dir`` (a file or a folder of files)."""
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute ``df`` only where its scan has fewer partitions than the cluster has cores.

    A table in one small file is one scan task; text work on it would use one core. Tables in
    many splits are left alone, so that nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle ``df`` by keys into as many partitions as the session shuffles into, at least one for each core.

    The adaptive planner joins partitions that are small in bytes; where a row's work is large for its bytes,
    that would leave the work to one core. A number given explicitly is kept.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


#: What is sent to every executor has at most so many rows and bytes.
SENT_ROWS, SENT_BYTES = 200_000, 64_000_000


def collected(df: DataFrame) -> list[tuple] | None:
    """The rows of ``df``, or null if it has more than SENT_ROWS rows or SENT_BYTES bytes."""
    got = df.limit(SENT_ROWS + 1).toArrow()
    if got.num_rows > SENT_ROWS or got.nbytes > SENT_BYTES:
        return None
    return list(zip(*(c.to_pylist() for c in got.columns)))


def settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` computed once and marked for broadcast where it is seen to have no more than SENT_ROWS rows and SENT_BYTES
    bytes, and whether it is so; a larger one is written to the shared folder, to be joined by a shuffle."""
    got = df.limit(SENT_ROWS + 1).toArrow()
    if got.num_rows > SENT_ROWS or got.nbytes > SENT_BYTES:
        return cut(df), False
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)), True


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder of ``spark.checkpoint.dir``.

    A local session that names none, as in tests, gets a folder of its own; a cluster must name one that all its nodes share.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "skillmill-checkpoints"))
    return df.checkpoint()
