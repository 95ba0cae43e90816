"""Session defaults and helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Python workers give large arrays back to the system at once instead of keeping them for reuse.
_ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2"}
_LOCAL_CHECKPOINTS = "/tmp/checkpoints/trellis"


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library, wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    for k, v in _ALLOCATOR.items():
        env.setdefault(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where it is unset and all tasks run on this machine (tests), a folder of our own serves.
    """
    jsc = spark.sparkContext._jsc.sc()
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        current = jsc.getCheckpointDir()
        known = current.get() if current.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"{_LOCAL_CHECKPOINTS}-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage and survives the loss of executors; the schema is kept, so empty tables work too.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/trellis-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any longer."""
    for t in tables:
        spark = t.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/trellis-" in f:
                p = spark._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
