"""Session helpers: a local session for tests/bench and checkpoint-dir lookup."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "claimwise") -> SparkSession:
    """Local session used by tests and the bench. On a cluster, use the
    cluster's own session; every operator only needs ``SparkSession``."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``. Only in local mode may it
    be unset; it then becomes a fresh scratch folder. On a cluster executors
    would write to their own disks, so an unset folder is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="claimwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which ``release`` deletes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/claimwise-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Of tables on the way: keys and amounts as text take about half the bytes of Spark's default.
PACKED = "zstd"


def materialize(df):
    """Cut lineage by writing ``df`` as a Parquet table under
    ``spark.checkpoint.dir`` (shared storage on a cluster) and reading it
    back: an intermediate read by several branches is computed once, its
    content no longer depends on a recomputation after an executor is lost,
    and later reads get column pruning and filter pushdown (which an RDD
    checkpoint cannot offer). One job; the table lives under the
    checkpoint folder until ``release`` or the cluster's housekeeping deletes it."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.mode("error").option("compression", PACKED).parquet(path)
    return spark.read.parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Spark deletes the shuffle files of a job that
    has ended once the driver holds nothing of it; with room left on its heap that may be
    never, and a job of several steps would keep the files of them all."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Prepared(str):
    """A data folder for a run of several queries: what ``prepared`` makes of it is made
    once, by the first query that asks, and read by the others."""

    def __init__(self, sf_dir: str):
        self._lock, self._locks, self._made = threading.Lock(), {}, {}

    def once(self, name: str, make: Callable):
        with self._lock:
            own = self._locks.setdefault(name, threading.Lock())
        with own:  # whoever comes second waits; after a failure the next one tries again
            if name not in self._made:
                self._made[name] = make()
        return self._made[name]


class PreparedForMany(Prepared):
    """For so many queries that claims with all that the dimensions say of them are worth a
    table, which takes more disk than a few queries save."""


def prepared(sf_dir: str, name: str, make: Callable, write: bool = True):
    """``make()``; for a ``Prepared`` folder only the first time, and (``write``) as a
    table that is written and read back."""
    if not isinstance(sf_dir, Prepared):
        return make()
    return sf_dir.once(name, (lambda: materialize(make())) if write else make)


_written: list[str] = []


def release() -> int:
    """Delete the tables and folders that ``materialize`` and ``scratch`` have named in
    this process; call it when their readers are done (the end of a job). Returns how
    many there were."""
    from pyarrow import fs

    done = 0
    while _written:
        path = _written.pop()
        system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        if system.get_file_info(name).type == fs.FileType.Directory:
            system.delete_dir(name)
            done += 1
    return done
