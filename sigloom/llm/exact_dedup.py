"""Exact duplicates by a tree merge of sorted digest runs.

Each partition turns its rows into a sorted run with one entry per digest.  In every round the runs of ``FAN_IN`` neighbouring blocks
meet, dealt by digest range, and are merged into one run per block and range; the entry that stays is carried upwards.  Copies
thus collapse at every level: a digest held by a third of all rows reaches a merge at most ``FAN_IN`` times per range.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Carried, Written, pick, without_space

FAN_IN_BITS = 4
_RUN = "block long, digest binary, width long, keep_chars long, keep_id long, keep_row long, group_size long, ties long"


def _collapse(batches):
    """Merge a sorted stream: the first entry of a (block, digest) stays, sizes add up.  Keeps one open entry between batches."""
    held = None
    for batch in batches:
        rows = pa.table(batch.columns, names=batch.schema.names)  # without the nullability marks, which differ between batches and results
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        digest = np.stack([np.frombuffer(x, "u8") for x in rows["digest"].to_pylist()])
        block, width = rows["block"].to_numpy(), rows["width"].to_numpy()
        new = np.r_[True, (block[1:] != block[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if (width != width[start][group]).any():
            raise ValueError("two texts of different length share a digest")
        first = rows.take(start)
        best = first["keep_chars"].to_numpy()[group] == rows["keep_chars"].to_numpy()
        best &= pc.fill_null(pc.equal(first["keep_id"].take(pa.array(group)), rows["keep_id"]), False).to_numpy(zero_copy_only=False) \
            | (pc.is_null(first["keep_id"].take(pa.array(group))).to_numpy(zero_copy_only=False) & pc.is_null(rows["keep_id"]).to_numpy(zero_copy_only=False))
        for name, values in (("group_size", rows["group_size"].to_numpy()), ("ties", np.where(best, rows["ties"].to_numpy(), 0))):
            first = first.set_column(first.column_names.index(name), name, pa.array(np.add.reduceat(values, start)))
        held = first.slice(first.num_rows - 1)
        yield from first.slice(0, first.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merged(runs: DataFrame) -> DataFrame:
    order = ["block", "digest", F.desc("keep_chars"), F.asc_nulls_last("keep_id"), "keep_row"]
    return runs.sortWithinPartitions(*order).mapInArrow(_collapse, _RUN)


def digests(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_chars, width, digest``: digest and length of the text without white space, length of the text itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text.alias("text"), without_space(text).alias("bare"))
    return bare.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.octet_length("bare").cast("long").alias("width"),
                       F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"))


def merged_runs(keyed: DataFrame, written: Written) -> DataFrame:
    """One entry per digest: ``digest, keep_id, keep_chars, keep_row, group_size, ties`` from written ``row, doc_id, n_chars, width, digest``."""
    runs = _merged(keyed.select(F.spark_partition_id().cast("long").alias("block"), "digest", "width", F.col("n_chars").alias("keep_chars"),
                                F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"),
                                F.lit(1).cast("long").alias("ties")))
    blocks, previous = keyed.rdd.getNumPartitions(), None
    while True:
        blocks = -(-blocks >> FAN_IN_BITS) if blocks > 1 else 1
        dealt = runs.withColumn("block", F.shiftright("block", FAN_IN_BITS)).repartition("block", F.substring("digest", 1, 3))
        runs = written.table(_merged(dealt))
        if previous is not None:
            written.drop(previous)
        previous = runs
        if blocks <= 1:
            return runs


def group_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space; null counts as empty.  Of equal texts the one with the most code
    points stays, then the smallest id, a null id last; of rows that repeat with one id exactly one is ``kept``.
    """
    written = Written(docs.sparkSession)
    keyed = written.table(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    entries = merged_runs(keyed, written)
    return keyed.join(entries.select("digest", "keep_id", "keep_row", "group_size"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  The rules are those of ``group_copies``."""
    written = Written(docs.sparkSession)
    keyed = written.table(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    entries = merged_runs(keyed, written)
    carried = Carried(docs)
    text = F.coalesce(carried.col(text_col).cast("string"), F.lit(""))
    rows = carried.frame.withColumns({"own_digest": F.unhex(F.sha2(without_space(text).cast("binary"), 256)),
                                      "own_chars": F.length(text).cast("long"), "own_id": carried.col(id_col).cast("long")})
    # the id is part of the key, so that the copies of one text are spread over all tasks
    stay = rows.join(entries.select("digest", "keep_id", "keep_chars", "ties"),
                     (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_chars") == F.col("keep_chars")))
    once = carried.back(stay.filter("ties = 1"))
    if entries.filter("ties > 1").isEmpty():
        return once
    repeated = stay.filter("ties > 1").withColumn("own_row", F.monotonically_increasing_id())
    return once.unionAll(carried.back(repeated.dropDuplicates(["digest"])))
