"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quaestor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


# Tables that hold a few rows at any scale; they are read as they come.
FIXED = {"course_meta", "eval_items", "containers", "region", "nation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in FIXED else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out to all cores where a table comes in fewer pieces than there are cores (one small file cannot be
    split); tables in more pieces, as on a cluster, stay as they are read and are not shuffled. Filters and column selection
    still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a folder of our own is made,
    in local mode only (tests), and removed at exit; on a cluster a missing setting is an error, as a folder of one
    machine would be lost with it. Unlike a local checkpoint the files outlive any executor.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quaestor-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for files of our own, in the folder that all executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quaestor_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quaestor-code-")) / "quaestor_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._quaestor_shipped = True
