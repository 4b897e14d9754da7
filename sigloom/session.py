"""Session defaults and the shared checkpoint folder."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app="sigloom", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark):
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_sigloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sigloom-package-")) / "sigloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._sigloom_shipped = True
    return spark


def ensure_checkpoint_dir(spark):
    """Use the folder the cluster names; fall back to a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="sigloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    A lost executor then never replays a loop.  A table is used rather than ``checkpoint()`` because the latter hands
    inferred constraints on to the next plan, which grow from round to round in a loop of self-joins; a table also
    has true sizes for the choice of join.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _on_its_file_system(spark, path)
    files.deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table._sigloom_path = path
    return table


def _on_its_file_system(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``cut_lineage`` has written."""
    return hasattr(df, "_sigloom_path")


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more; those that are left go with the session."""
    for table in tables:
        if is_written(table):
            target, files = _on_its_file_system(table.sparkSession, table._sigloom_path)
            files.delete(target, True)
