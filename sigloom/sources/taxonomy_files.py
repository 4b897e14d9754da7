"""Taxonomy and alias files."""

from pyspark.sql import DataFrame, functions as F

from sigloom.operators import taxonomy as T

_DUMP_SEPARATOR = "\t|\t"


def _pairs(spark, path, separator):
    """First and second field of every line; the second runs to the end of the line."""
    at = F.instr("value", F.lit(separator))
    lines = spark.read.text(path).where(at > 0)
    return lines.select(F.expr(f"substring(value, 1, instr(value, '{separator}') - 1)").alias("name"),
                        F.expr(f"trim(both '\\r' from substring(value, instr(value, '{separator}') + {len(separator)}))").alias("text"))


def read_lineages(spark, path, form="GTDB") -> DataFrame:
    """``name, lineage`` from ``name<TAB>d__…;p__…`` (GTDB) or ``name,PhylumClass…_Genus_species`` (PCOF_S) lines."""
    if form == "GTDB":
        return _pairs(spark, path, "\t").select("name", T.gtdb_lineage("text").alias("lineage"))
    if form == "PCOF_S":
        return _pairs(spark, path, ",").select("name", T.pcof_lineage("text").alias("lineage"))
    raise ValueError(f"unknown taxonomy form {form!r}; expected GTDB, PCOF_S or NCBI")


def read_aliases(spark, path) -> DataFrame:
    """``old, new`` from comma-separated lines; further fields are ignored."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(F.contains("value", F.lit(","))).select(
        F.get(parts, F.lit(0)).alias("old"), F.regexp_replace(F.get(parts, F.lit(1)), "\r", "").alias("new"))


def _dump(spark, path, *names):
    fields = F.split(F.regexp_replace("value", "\t\\|\r?$", ""), "\t\\|\t")
    return spark.read.text(path).select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_ncbi_tree(spark, nodes_path, merged_path=None, names_path=None) -> DataFrame:
    """``name, level, parent[, label]`` from the dump files of a taxonomy; merged ids become redirecting rows."""
    nodes = _dump(spark, nodes_path, "name", "parent", "rank").select("name", T.rank_level("rank").alias("level"), "parent")
    if merged_path:
        nodes = T.apply_aliases(nodes, _dump(spark, merged_path, "old", "new")).drop("alias_of")
    if names_path:
        names = _dump(spark, names_path, "id", "name", "unique", "class")
        nodes = T.add_labels(nodes, names)
    return nodes


def read_ncbi_lineages(spark, leaves_path, nodes_path, merged_path=None, names_path=None) -> DataFrame:
    """``name, lineage`` of the samples in ``name,taxid`` lines."""
    tree = read_ncbi_tree(spark, nodes_path, merged_path, names_path)
    leaves = _pairs(spark, leaves_path, ",").select("name", F.regexp_extract("text", "^([^,]*)", 1).alias("taxon"))
    lineages = T.ancestor_lineages(T.add_leaves(tree, leaves))
    return leaves.select("name").join(lineages, "name", "left")


def save_tree(nodes: DataFrame, path):
    """Parsed trees are kept as tables next to their source."""
    nodes.write.mode("overwrite").parquet(path)


def load_tree(spark, path) -> DataFrame:
    return spark.read.parquet(path)
