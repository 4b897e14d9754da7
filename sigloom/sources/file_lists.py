"""Which inputs a run reads, and in which order."""

from pyspark.sql import DataFrame, functions as F

_PART = 1 << 26  # files that one list may name
SEARCH_OFFSET = 2 * _PART  # the search input is numbered behind everything else


def listed_files(spark, list_path=None, extra=(), search=None) -> DataFrame:
    """``ord, path``: the lines of the list file, then ``extra`` paths, then the search file last."""
    parts = []
    if list_path:
        lines = spark.read.text(list_path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "path"))
        parts.append(lines.where(F.trim("path") != "").select(F.lit(0).alias("part"), "pos", F.trim("path").alias("path")))
    tail = [(1, i, p) for i, p in enumerate(extra)] + ([(2, 0, search)] if search else [])
    if tail or not parts:
        parts.append(spark.createDataFrame(tail, "part int, pos int, path string"))
    listed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return listed.select((F.col("part").cast("long") * _PART + F.col("pos")).alias("ord"), "path")


def existing(spark, paths):
    """The paths that exist on their file system, in order: one listing per folder, not one question per file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = {p: jvm.org.apache.hadoop.fs.Path(p) for p in paths}
    there = {}
    for p in paths:
        parent = hadoop[p].getParent()
        folder = parent.toString() if parent is not None else ""
        if folder not in there:
            system = hadoop[p].getFileSystem(conf)
            there[folder] = {s.getPath().getName() for s in system.listStatus(parent)} if parent is not None and system.exists(parent) else set()
    return [p for p in paths if hadoop[p].getName() in there[hadoop[p].getParent().toString() if hadoop[p].getParent() is not None else ""]]
