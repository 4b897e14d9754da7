"""Maximal exact matches between sequences, and the heaviest chain of them.

A match is maximal when neither its bases before nor behind agree.  Seeds carry the bases on either side, so a hit of two seeds shows by itself whether a match
begins or ends there; all hits inside a match are dropped where they arise, and a match leaves two rows however long it is.  Begins and ends
lie in turn on a diagonal: they are paired within chunks of it, and what a chunk leaves open, one row at most on either side, is paired along the diagonal.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sigloom.operators.dealing import dealt_join
from sigloom.operators.kmers import MAX_K, _text_buffers, in_pieces, rolling_codes
from sigloom.session import cut_lineage

#: Places of a diagonal that are paired in one group.
CHUNK = 1 << 16


def _flanked(k, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text_buffers(batch.column(batch.num_columns - 1))
            offsets = np.asarray(offsets, np.int64)
            for row, pos, code in rolling_codes(raw, offsets, k):
                inside = (pos > 0) & (offsets[row] + pos + k < offsets[row + 1])
                row, pos, code = row[inside], pos[inside], code[inside]
                at, take = offsets[row] + pos, pa.array(row)
                yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns[:-1]] + [pa.array(pos), pa.array(code), pa.array(raw[at - 1].astype(np.int16)), pa.array(raw[at + k].astype(np.int16))], names=names)
    return run


def flanked_seeds(frame: DataFrame, k, edge, seq_col="seq") -> DataFrame:
    """``…, pos, code, before, behind``: every k-mer with the characters around it; ``edge`` stands at both ends of a sequence and for what is no base."""
    rest = [c for c in frame.columns if c != seq_col]
    padded = F.concat(F.lit(edge), F.regexp_replace(F.upper(F.coalesce(seq_col, F.lit(""))), "[^ACGT]", edge), F.lit(edge))
    cut = in_pieces(frame.withColumn(seq_col, padded), k + 2, seq_col)
    schema = T.StructType([cut.schema[c] for c in [*rest, "_from"]] + [T.StructField("pos", T.LongType()), T.StructField("code", T.LongType()),
                                                                       T.StructField("before", T.ShortType()), T.StructField("behind", T.ShortType())])
    found = cut.select(*rest, "_from", seq_col).mapInArrow(_flanked(k, schema.fieldNames()), schema)
    return found.select(*rest, (F.col("pos") + F.col("_from") - 1).alias("pos"), "code", "before", "behind")


def maximal_matches(queries: DataFrame, references: DataFrame, min_length: int, chunk=None) -> DataFrame:
    """``query, ref, query_pos, ref_pos, length`` of all maximal exact matches of at least ``min_length`` bases, from ``id, seq`` tables.

    Positions count from 0.  Letters other than A, C, G and T match nothing.  A seed that is in very many places is dealt over salts; its matches are all there.
    """
    k, chunk = min(min_length, MAX_K), chunk or CHUNK
    mine = flanked_seeds(queries.select(F.col("id").alias("query"), "seq"), k, "<").withColumnsRenamed({"pos": "query_pos", "before": "a0", "behind": "a1"})
    theirs = flanked_seeds(references.select(F.col("id").alias("ref"), "seq"), k, ">").withColumnsRenamed({"pos": "ref_pos", "before": "b0", "behind": "b1"})
    hits = dealt_join(mine, theirs, ["code"], ["query", "query_pos"])
    begins, ends = F.col("a0") != F.col("b0"), F.col("a1") != F.col("b1")
    hits = hits.where(begins | ends).select("query", "ref", (F.col("query_pos") - F.col("ref_pos")).alias("diagonal"), "query_pos", begins.alias("begins"), ends.alias("ends"))
    # a hit that begins and ends is a match of k bases
    whole = hits.where("begins and ends").select("query", "ref", "diagonal", F.col("query_pos").alias("first"), F.col("query_pos").alias("last"))
    rest = hits.where("not (begins and ends)").withColumn("chunk", F.floor(F.col("query_pos") / chunk))
    line = ["query", "ref", "diagonal"]

    def paired(rows, within):
        along = Window.partitionBy(*within).orderBy("query_pos")
        return rows.withColumns({"_next": F.lead("query_pos").over(along), "_ends": F.lead("ends").over(along), "_begun": F.coalesce(F.lag("begins").over(along), F.lit(False))})

    near = cut_lineage(paired(rest, [*line, "chunk"]))
    closed = near.where("begins and _ends").select(*line, F.col("query_pos").alias("first"), F.col("_next").alias("last"))
    open_ = near.where("(begins and not coalesce(_ends, false)) or (ends and not _begun)").select(*line, "query_pos", "begins", "ends")
    far = paired(open_, line).where("begins and _ends").select(*line, F.col("query_pos").alias("first"), F.col("_next").alias("last"))
    found = whole.unionAll(closed).unionAll(far).withColumn("length", F.col("last") - F.col("first") + k)
    return found.where(F.col("length") >= min_length).select("query", "ref", F.col("first").alias("query_pos"), (F.col("first") - F.col("diagonal")).alias("ref_pos"), "length")


# ---------------------------------------------------------------- chains

def heaviest_chain(query_pos, ref_pos, length):
    """``bases, mismatches, query_span, ref_span`` of the chain of matches that covers most bases and rises in both sequences.

    A match may follow another that begins before it in both; what they share is counted once.  Among chains of equal weight the one whose end comes first wins.
    ``mismatches`` are single differing bases between two matches that follow each other on one diagonal.  Time grows with the square of the matches of one pair.
    """
    order = np.lexsort((ref_pos, query_pos))
    q, r, n = (np.asarray(x, np.int64)[order] for x in (query_pos, ref_pos, length))
    best, before = n.copy(), np.full(len(n), -1)
    for i in range(1, len(n)):
        shared = np.maximum(0, np.maximum(q[:i] + n[:i] - q[i], r[:i] + n[:i] - r[i]))
        gain = np.where((q[:i] < q[i]) & (r[:i] < r[i]) & (shared < n[i]), best[:i] + n[i] - shared, 0)
        j = int(gain.argmax())
        if gain[j] > best[i]:
            best[i], before[i] = gain[j], j
    i = int(best.argmax())
    bases, end_q, end_r, single = int(best[i]), q[i] + n[i], r[i] + n[i], 0
    while before[i] >= 0:
        j = before[i]
        single += q[i] - q[j] == r[i] - r[j] and q[i] == q[j] + n[j] + 1
        i = j
    return bases, int(single), int(end_q - q[i]), int(end_r - r[i])


def _chained(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bases, single, span_q, span_r = heaviest_chain(*(table.column(c).to_numpy() for c in ("query_pos", "ref_pos", "length")))
        yield pa.RecordBatch.from_arrays([table.column("query").combine_chunks()[:1], table.column("ref").combine_chunks()[:1], *(pa.array([x]) for x in (bases, single, span_q, span_r))], names=names)
    return run


def rough_alignment(queries: DataFrame, references: DataFrame, min_length: int) -> DataFrame:
    """``query, ref, matches, aligned, dist`` of every pair with a maximal match.

    ``matches`` are the bases of the heaviest chain, ``aligned`` is the longer of the two stretches it spans, and ``dist = 1 - matches / aligned``.
    Single differing bases between matches of one diagonal lie inside the stretch, so they count as aligned.  Pairs without a match have no row.
    """
    found = maximal_matches(queries, references, min_length)
    schema = T.StructType([found.schema["query"], found.schema["ref"], *[T.StructField(c, T.LongType()) for c in ("matches", "mismatches", "span_q", "span_r")]])
    chains = found.groupBy("query", "ref").applyInArrow(_chained(schema.fieldNames()), schema)
    aligned = F.greatest("span_q", "span_r")
    return chains.select("query", "ref", "matches", "mismatches", aligned.alias("aligned"), (1.0 - F.col("matches") / aligned).alias("dist"))
