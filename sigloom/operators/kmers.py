"""K-mer tables.

Counting is one pass over the contigs and one shuffle of small partial counts.  Each Arrow batch is encoded to
base-4 codes with numpy and pre-aggregated per genome, so what is shuffled per batch and genome is at most one row per
distinct k-mer rather than one per base; a genome holding a third of all bases therefore arrives as many partial
tables spread over ``(genome, kmer)``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.functions.sequences import slice_text

MAX_K = 31
PIECE = 1 << 22  # bases of a contig that one row holds at most while k-mers are read
_SEGMENT = 1 << 21  # bases encoded at a time, which bounds the working arrays of a long contig

_CODES = np.full(256, 4, dtype=np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _letter in _letters:
        _CODES[ord(_letter)] = _code


def _text_buffers(column):
    """Bytes and offsets of a string column without copying the text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def rolling_codes(raw, offsets, k):
    """Yield ``(row, position, code)`` arrays for every N-free k-mer of every row, a bounded segment at a time."""
    first, last = int(offsets[0]), int(offsets[-1])
    for start in range(first, last, _SEGMENT):
        stop = min(last, start + _SEGMENT + k - 1)
        n = stop - start - k + 1
        if n <= 0:
            continue
        digits = _CODES[raw[start:stop]]
        code = np.zeros(n, dtype=np.int64)
        for j in range(k):
            code *= 4
            code += digits[j:j + n]
        bad = np.concatenate(([0], np.cumsum(digits > 3, dtype=np.int32)))
        at = np.arange(start, start + n)
        row = np.searchsorted(offsets, at, side="right") - 1
        keep = (bad[k:k + n] == bad[:n]) & (at + k <= offsets[row + 1])
        row = row[keep]
        yield row, at[keep] - offsets[row], code[keep]


def in_pieces(frame: DataFrame, k, seq_col="seq", piece=PIECE) -> DataFrame:
    """Sequences longer than ``piece`` bases as several rows that overlap by ``k - 1``, so each k-mer is in exactly one; ``_from`` is where a row starts.

    Shorter sequences pass as they are.  A giant contig then is many rows of bounded size.
    """
    long = F.length(seq_col) > piece
    starts = F.when(long, F.sequence(F.lit(0), F.length(seq_col) - 1, F.lit(piece))).otherwise(F.array(F.lit(0)))
    cut = frame.withColumn("_from", F.explode(starts))
    return cut.withColumn(seq_col, F.when(long, slice_text(seq_col, F.col("_from") + 1, F.lit(piece + k - 1))).otherwise(F.col(seq_col)))


def reverse_complement_codes(codes, k):
    out = np.zeros_like(codes)
    rest = codes.copy()
    for _ in range(k):
        out = out * 4 + (3 - rest % 4)
        rest //= 4
    return out


def _local_groups(column):
    encoded = column.dictionary_encode()
    return encoded.dictionary, np.asarray(encoded.indices)


def _count_by(group, code, weight=None):
    """Distinct ``(group, code)`` pairs with their number (or summed weight)."""
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (code[1:] != code[:-1]))))
    if weight is None:
        total = np.diff(np.append(first, len(group)))
    else:
        total = np.add.reduceat(weight[order], first)
    return group[first], code[first], total


_DENSE_BINS = 1 << 24  # up to this many (genome, k-mer) cells a batch is counted by direct addressing


def _count_words(group, code, k, n_groups):
    """``_count_by`` for k-mer codes: a histogram where the key space is small, sorting where it is not."""
    size = 4 ** k
    if n_groups * size > _DENSE_BINS:
        return _count_by(group, code)
    counts = np.bincount(group * size + code, minlength=n_groups * size)
    used = np.flatnonzero(counts)
    return used // size, used % size, counts[used]


def _partial_counts(k, double_strand, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            genomes, group = _local_groups(batch.column(0))
            raw, offsets = _text_buffers(batch.column(1))
            held = [_count_words(group[row].astype(np.int64), code, k, len(genomes)) for row, _, code in rolling_codes(raw, offsets, k) if len(row)]
            # a zero row per genome keeps genomes without any k-mer in the result of this one pass
            every = np.arange(len(genomes))
            held.append((every, np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)))
            owner, code, n = (np.concatenate(parts) for parts in zip(*held))
            if double_strand:
                owner, n = np.concatenate((owner, owner)), np.concatenate((n, n))
                code = np.concatenate((code, reverse_complement_codes(code, k)))
            owner, code, n = _count_by(owner, code, n)
            yield pa.RecordBatch.from_arrays([genomes.take(pa.array(owner)), pa.array(code), pa.array(n)], names=names)
    return run


def kmer_counts(contigs: DataFrame, k, *, double_strand=True, keep_empty=False,
                genome_col="genome_id", seq_col="seq") -> DataFrame:
    """``genome_id, code, n``: k-mer occurrences per genome, never across contigs or an N.

    ``code`` is the base-4 number of the k-mer (first base most significant).  With ``double_strand`` the reverse
    complement of every occurrence counts as well, so a palindrome counts twice.  ``keep_empty`` leaves a zero row for
    genomes without k-mers.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    frame = contigs.select(F.col(genome_col).alias("genome_id"), F.col(seq_col).alias("seq"))
    frame = in_pieces(frame, k).drop("_from")
    schema = T.StructType([frame.schema["genome_id"], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    partial = frame.mapInArrow(_partial_counts(k, double_strand, schema.fieldNames()), schema)
    counts = partial.groupBy("genome_id", "code").agg(F.sum("n").alias("n"))
    return counts if keep_empty else counts.where(F.col("n") > 0)


def kmer_counts_of(contigs: DataFrame, sizes, *, double_strand=True) -> DataFrame:
    """``genome_id, k, code, n`` for several word lengths in one pass over the contigs; a zero row per genome and length keeps empty genomes."""
    frame = contigs.select("genome_id", "seq")
    schema = T.StructType([frame.schema["genome_id"], T.StructField("k", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    counters = [(k, _partial_counts(k, double_strand, ["genome_id", "code", "n"])) for k in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, count in counters:
                for part in count(iter([batch])):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, k, np.int32)), part.column(1), part.column(2)], names=schema.fieldNames())

    return frame.mapInArrow(run, schema).groupBy("genome_id", "k", "code").agg(F.sum("n").alias("n"))


def kmer_text(code, k):
    """The bases of a k-mer code."""
    code = F.col(code) if isinstance(code, str) else code
    return F.translate(F.lpad(F.conv(code, 10, 4), k, "0"), "0123", "ACGT")


def kmer_code(text):
    """The code of a k-mer given as text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.conv(F.translate(text, "ACGT", "0123"), 4, 10).cast("long")


def dense_profile(counts: DataFrame, k, value="n", share=False) -> DataFrame:
    """``genome_id, sig``: one array of ``4^k`` values per genome, zero where a k-mer is absent; with ``share`` they are divided by their sum."""
    size = 4 ** k
    sparse = counts.groupBy("genome_id").agg(F.collect_list(F.struct("code", F.col(value).cast("double").alias("v"))).alias("held"))
    schema = T.StructType([counts.schema["genome_id"], T.StructField("sig", T.ArrayType(T.DoubleType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            for start in range(0, batch.num_rows, max(1, (1 << 22) // size)):
                part = held.slice(start, max(1, (1 << 22) // size))
                entries = part.flatten()
                rows = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths()))
                dense = np.zeros((len(part), size))
                dense[rows, np.asarray(entries.field("code"))] = np.asarray(entries.field("v"))
                if share:
                    total = dense.sum(axis=1, keepdims=True)
                    dense /= np.where(total > 0, total, 1.0)
                ends = pa.array(np.arange(0, dense.size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))],
                    names=["genome_id", "sig"])

    return sparse.mapInArrow(fill, schema)


def kmer_frequencies(counts: DataFrame) -> DataFrame:
    """``genome_id, code, freq``: share of every k-mer among all k-mers of its genome."""
    totals = counts.groupBy("genome_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "genome_id").select(
        "genome_id", "code", (F.col("n") / F.col("total")).alias("freq"))


def canonical_only(counts: DataFrame, k) -> DataFrame:
    """Keep a k-mer when it is not larger than its reverse complement."""
    text = kmer_text("code", k)
    return counts.where(text <= F.reverse(F.translate(text, "ACGT", "TGCA")))


def gc_content(contigs: DataFrame) -> DataFrame:
    """``genome_id, gc``: share of C and G among all positions, N included."""
    from sigloom.functions.sequences import gc_count

    sums = contigs.groupBy("genome_id").agg(F.sum(gc_count("seq")).alias("gc"), F.sum(F.length("seq")).alias("total"))
    return sums.select("genome_id", F.try_divide(F.col("gc").cast("double"), F.col("total").cast("double")).alias("gc"))


def gc_content_known(contigs: DataFrame) -> DataFrame:
    """``genome_id, gc``: share of C and G among the A, C, G and T positions only."""
    from sigloom.functions.sequences import gc_count

    known = F.length(F.regexp_replace("seq", "[^ACGT]", ""))
    sums = contigs.groupBy("genome_id").agg(F.sum(gc_count("seq")).alias("gc"), F.sum(known).alias("total"))
    return sums.select("genome_id", F.try_divide(F.col("gc").cast("double"), F.col("total").cast("double")).alias("gc"))


def genome_length(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("genome_id").agg(F.sum(F.length("seq")).cast("long").alias("length"))


def windows(contigs: DataFrame, size=1000, step=None, count=None) -> DataFrame:
    """Sliding windows of every contig, named ``<contig>.<i>``; a partial last window is dropped.

    With ``count`` the windows are spread evenly: at most ``count`` of them, at multiples of
    ``(length - size - 1) / step``.
    """
    step = step or size
    length = F.length("seq")
    n = (F.floor((length - size) / step) + 1).cast("int")
    if count is None:
        wanted, start = n, lambda i: i * step
    else:
        wanted = F.least(n, F.lit(count))
        stride = (length - size - 1).cast("double") / F.lit(float(step))
        start = lambda i: F.floor(i * stride + 0.01).cast("int")
    rows = contigs.where(length >= size).select("*", F.explode(F.sequence(F.lit(0), wanted - 1)).alias("window"))
    begin = start(F.col("window"))
    return rows.select(
        *[c for c in contigs.columns if c not in ("seq", "name")],
        F.concat_ws(".", F.col("name"), F.col("window")).alias("name") if "name" in contigs.columns else F.col("window").cast("string").alias("name"),
        "window", begin.cast("long").alias("start"), slice_text("seq", begin + 1, F.lit(size)).alias("seq"))


def window_genomes(contigs: DataFrame, size, step=None) -> DataFrame:
    """Every window as a genome of its own: ``genome_id`` is ``<genome>:<contig>.<window>``; contigs shorter than a window have none."""
    rows = windows(contigs.select("genome_id", "ord", "seq"), size, step)
    name = F.concat(F.col("genome_id").cast("string"), F.lit(":"), F.col("ord").cast("string"), F.lit("."), F.col("window").cast("string"))
    return rows.select(name.alias("genome_id"), F.col("window").cast("long").alias("ord"), "name", "seq")


def _minimizer_rows(window, size, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text_buffers(batch.column(batch.num_columns - 1))
            keys = batch.columns[:-1]
            for r in range(batch.num_rows):
                text = raw[offsets[r]:offsets[r + 1]]
                span = window - size + 1
                if len(text) < window:
                    continue
                positions = _window_minima(text, window, size, span)
                emitted = positions[np.concatenate(([True], positions[1:] > np.maximum.accumulate(positions)[:-1]))]
                take = pa.array(np.full(len(emitted), r))
                yield pa.RecordBatch.from_arrays(
                    [k.take(take) for k in keys] + [pa.array(np.arange(len(emitted))), pa.array(emitted)], names=names)
    return run


def _window_minima(text, window, size, span):
    """Leftmost position of the smallest ``size``-mer in every window."""
    n = len(text) - size + 1
    view = np.lib.stride_tricks.sliding_window_view(text, size)
    order = np.lexsort(view.T[::-1])
    step = np.concatenate(([False], (view[order][1:] != view[order][:-1]).any(axis=1)))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(step)
    out = np.empty(n - span + 1, np.int64)
    for start in range(0, len(out), 1 << 16):
        block = np.lib.stride_tricks.sliding_window_view(rank[start:start + (1 << 16) + span - 1], span)
        out[start:start + len(block)] = start + np.arange(len(block)) + block.argmin(axis=1)
    return out


def minimizers(contigs: DataFrame, window, size) -> DataFrame:
    """``…, idx, pos``: start of the smallest ``size``-mer of each window, listed when it moves to the right."""
    frame = contigs.select(*[c for c in contigs.columns if c not in ("seq", "name")], "seq")
    schema = T.StructType([f for f in frame.schema.fields if f.name != "seq"]
                          + [T.StructField("idx", T.LongType()), T.StructField("pos", T.LongType())])
    return frame.mapInArrow(_minimizer_rows(window, size, schema.fieldNames()), schema)
