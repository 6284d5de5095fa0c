"""Session factory and the shipping of this package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow transfer, whose workers have this package; further settings by keyword with _ for dots."""
    builder = SparkSession.builder.appName("tallyloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever they run; does nothing the second time."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom_package.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
            for source in sorted(root.rglob("*.py")):
                packed.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(out))
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; only a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder: it cuts the plan of a loop and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: narrower on disk than rows of a checkpoint, and a later step reads only the columns it needs."""
    folder = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
