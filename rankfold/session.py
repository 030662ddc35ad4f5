"""Session helpers: configuration defaults and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "rankfold", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs.  On a cluster, pass your own session."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (or one set on the context).  Only when
    nothing is set *and* the master is local (tests, laptops) do we make a
    fresh scratch folder; a cluster must name a shared folder itself.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="rankfold-ckpt-", dir=os.environ.get("RANKFOLD_SCRATCH", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or S3) before running loops")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that begin here remove their shuffle files when they end, not when the driver happens to collect its
    garbage: for writes, whose exchanges nobody reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame, cache: bool = False) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Used once per round of every iterative loop (power iteration, ALS), so
    plans stay short and a lost executor only recomputes the current round.
    The exchanges that made ``df`` leave the disk with the write, which those
    of a persisted frame don't.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rankfold_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if cache:
        # re-read many times (e.g. by every ALS round): keep it in executor memory too
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    return out


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rankfold`` importable in Python workers (like ``--py-files``).

    Only the Arrow-batched Python steps (ALS solves, keyed stream state)
    need it.  Skipped when the workers can already import the package
    (installed on the cluster image).
    """
    import importlib.util
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    spec = importlib.util.find_spec("rankfold")
    if spec is not None and os.environ.get("PYTHONPATH", "").find(root) >= 0:
        _SHIPPED.add(key)
        return
    out_dir = tempfile.mkdtemp(prefix="rankfold-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "rankfold"), "zip", root_dir=root, base_dir="rankfold")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


#: Cells from which on every round of a loop is stored: exchanges of persisted rounds stay on disk.
STORE_ROUNDS_FROM = 10_000_000


class Rounds:
    """Materialise the state of an iterative loop without re-running it.

    Every round's frame is persisted (computed once, inside the next job
    that needs it); every ``every``-th round is stored (:func:`cut_lineage`) and the earlier persisted rounds are dropped, so the plan
    never grows beyond ``every`` rounds and a lost executor recomputes at
    most that many from the last checkpoint.
    """

    def __init__(self, every: int = 3):
        self.every = max(1, int(every))
        self.count = 0
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        from pyspark import StorageLevel

        self.count += 1
        if self.count % self.every == 0:
            out = cut_lineage(df)
            self.release()
            return out
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(out)
        return out

    def release(self) -> None:
        for d in self.held:
            d.unpersist()
        self.held = []
