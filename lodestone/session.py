"""Session helpers: table access, checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lodestone", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the engine is tuned for (AQE, UTC, Arrow)."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers once per application, so that no worker needs it on its path."""
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_lodestone_shipped", False):
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._lodestone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A parquet table of ``sf_dir``; naming the columns keeps the scan narrow."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lodestone-")
    sc.setCheckpointDir(conf)
    return conf


#: Deletes the shuffle files of a query once it has run; where Spark does not know it, they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, drop: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; ``drop`` deletes the shuffle files behind it at once."""
    spark = df.sparkSession
    ship(spark)
    shared_dir(spark)
    if not drop:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, used to guard broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A side is broadcast by hint only if Catalyst's own estimate is below this many bytes.
BROADCAST_LIMIT = 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``broadcast(df)`` if its estimated size is within ``limit``; else ``df``, for a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
