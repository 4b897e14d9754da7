"""Near-duplicate documents by a Jaccard join on word shingles with prefix, length, positional and suffix filters.

* Texts with the same shingle set are one item from the start; copies come back as members at the end.
* Shingles are ordered rare-first.  The frequencies come from a count sketch of fixed size over all documents; any fixed order keeps the
  join exact, a truer one only makes it cheaper.
* Two items can reach the threshold only if their prefixes share a shingle; only prefix shingles are shuffled.
* First each item is compared with the best of the *leaders* of its shingles, the item that has the shingle nearest to its front.  A
  large group of near copies falls into one component that way, with one pair per item.
* Then all pairs of items that are still in different components are joined on their prefix shingles, filtered by length, position and suffix
  counts, and verified once.  Pairs within a component need no check: their link could not change the result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Carried, Written, pick
from sigloom.llm.components import components
from sigloom.llm.shingles import set_digest, shingle_sets

#: Threshold as a fraction: 100 * intersection >= 80 * union.
PERCENT = 80
#: Counters of the frequency sketch, and how many travel as one row.
SKETCH, SKETCH_ROW = 1 << 20, 1 << 12
#: Shingles that more items have than this are led by several leaders, so no task gets all their items.
LEAD_BITS = 20
#: Candidates up to this number are sent to the text scan; beyond it the scan is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _needed(a, b):
    """The smallest intersection of sets of sizes ``a`` and ``b`` that reaches the threshold."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def _prefix(n):
    return n - -((-PERCENT * n) // 100) + 1


def needed(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _sid(digest: bytes, seed: int) -> int:
    return int.from_bytes(digest[:8], "little", signed=True) ^ seed


# ---------------------------------------------------------------------------------------------------------------- items and frequencies
def _scan(docs: DataFrame, written: Written) -> DataFrame:
    """``doc_id, n, digest`` of every row, and the sketch of each task as rows of ``part, counts``."""
    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            for at in range(0, len(sets), 64):
                some = np.concatenate(sets[at:at + 64])
                total += np.bincount((some & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "n", "digest", "part", "counts"])
        rows = [(i, part) for i, part in enumerate(total.reshape(-1, SKETCH_ROW)) if part.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()),
                pa.array([i for i, _ in rows], pa.int32()), pa.array([_squeezed(p) for _, p in rows], pa.binary())], names=["doc_id", "n", "digest", "part", "counts"])

    return written.table(docs.mapInArrow(run, "doc_id long, n long, digest binary, part int, counts binary"))


def _squeezed(counts):
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _frequencies(scanned: DataFrame) -> np.ndarray:
    """The logarithm of each counter of the sketch: one byte each, so the size is ``SKETCH`` whatever the data.

    Rows are added up in two rounds, so that many tasks do not meet in one.
    """
    def added(keys, out):
        def run(batches):
            totals = {}
            for batch in batches:
                for *key, counts in zip(*(batch.column(k).to_pylist() for k in (*keys, "counts"))):
                    counts = np.frombuffer(pa.decompress(counts, SKETCH_ROW * 8, codec="zstd"), np.int64)
                    totals[tuple(key)] = totals.get(tuple(key), 0) + counts
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.int32()), pa.array([out(c) for c in totals.values()], pa.binary())], names=["part", "counts"])
        return run

    rows = scanned.filter("part is not null").select("part", "counts", (F.spark_partition_id() % 64).alias("salt"))
    schema = "part int, counts binary"
    some = rows.repartition("part", "salt").mapInArrow(added(["part", "salt"], _squeezed), schema)
    all_of = some.repartition("part").mapInArrow(added(["part"], lambda c: _levels(c).tobytes()), schema)
    levels = np.zeros(SKETCH, np.uint8)
    for row in all_of.collect():  # SKETCH bytes in all
        levels[row["part"] * SKETCH_ROW:(row["part"] + 1) * SKETCH_ROW] = np.frombuffer(row["counts"], np.uint8)
    return levels


def _levels(counts):
    """Quarter powers of two: fine enough to order, coarse enough for a byte."""
    return np.minimum(np.ceil(4 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Rare-first: by frequency level, then by hash."""
    return grams[np.lexsort((grams, levels[grams & np.uint64(SKETCH - 1)]))]


# ---------------------------------------------------------------------------------------------------------------- prefixes
def _prefixes(docs: DataFrame, levels, seed: int) -> DataFrame:
    """``gram, salt, pos, sid, n`` of the prefix shingles; a text that a task meets again is not sent again."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        levels, met = shared.value, set()
        for batch in batches:
            grams, pos, sids, sizes = [], [], [], []
            for grams_of in shingle_sets(batch.column("text")):
                n = len(grams_of)
                if not n:
                    continue
                sid = _sid(set_digest(grams_of), seed)
                if sid in met:
                    continue
                met.add(sid)
                keep = _prefix(n)
                grams.append(ordered(grams_of, levels)[:keep])
                pos.append(np.arange(keep, dtype=np.int32))
                sids.append(np.full(keep, sid, np.int64))
                sizes.append(np.full(keep, n, np.int32))
                if sum(map(len, grams[-64:])) > 200_000:
                    yield _posted(levels, grams, pos, sids, sizes)
                    grams, pos, sids, sizes = [], [], [], []
            if grams:
                yield _posted(levels, grams, pos, sids, sizes)

    return docs.mapInArrow(run, "gram long, salt int, pos int, sid long, n int")


def _posted(levels, grams, pos, sids, sizes):
    gram, sid = np.concatenate(grams), np.concatenate(sids)
    spread = np.maximum(levels[gram & np.uint64(SKETCH - 1)].astype(np.int64) // 4 - LEAD_BITS, 0)
    # salt 0 means unsplit: a split shingle is dealt over the salts from 1 on
    salt = np.where(spread > 0, 1 + (sid & ((np.int64(1) << np.minimum(spread, 20)) - 1)), 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(salt), pa.array(np.concatenate(pos)), pa.array(sid), pa.array(np.concatenate(sizes))],
                                      names=["gram", "salt", "pos", "sid", "n"])


_LED = "gram long, pos int, sid long, n int, lead_sid long, lead_pos int, lead_n int"


def _led(batches):
    """From rows sorted by gram, salt, pos, sid: repeats and lone shingles go, each row gets the first of its shingle as leader.

    One shingle's first row and a flag are all that is kept between batches.
    """
    head = waiting = previous = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, salt, pos, sid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "salt", "pos", "sid", "n"))
        key = np.c_[gram, salt.astype(np.int64)]
        row = np.c_[key, pos.astype(np.int64), sid]
        fresh = np.r_[previous is None or (row[0] != previous).any(), (row[1:] != row[:-1]).any(axis=1)]
        previous = row[-1]
        gram, salt, pos, sid, n, key = (x[fresh] for x in (gram, salt, pos, sid, n, key))
        if not len(gram):
            continue
        begins = np.r_[head is None or (key[0] != head[0]).any(), (key[1:] != key[:-1]).any(axis=1)]
        group = np.cumsum(begins)  # 0: goes on with the open shingle
        firsts = np.flatnonzero(begins)
        sizes = np.bincount(group, minlength=len(firsts) + 1)
        lead = np.r_[-1, firsts][group]
        lead_sid, lead_pos, lead_n = sid[lead], pos[lead], n[lead]
        on = group == 0
        out = [[], [], [], [], [], [], []]
        if on.any():
            _, open_sid, open_pos, open_n = head
            lead_sid[on], lead_pos[on], lead_n[on] = open_sid, open_pos, open_n
            if waiting is not None:
                for column, value in zip(out, waiting):
                    column.append(np.array([value]))
                waiting = None
        # the last shingle may go on in the next batch; a shingle of one row waits; a row of a split one is always kept, as the others may have other salts
        last = group == len(firsts)
        keep = (sizes[group] > 1) | on | (salt > 0)
        if len(firsts):
            at = firsts[-1]
            head = (key[at], sid[at], pos[at], n[at])
            waiting = None
            if last.sum() == 1 and not keep[at]:
                waiting = (gram[at], pos[at], sid[at], n[at], sid[at], pos[at], n[at])
        for column, values in zip(out, (gram, pos, sid, n, lead_sid, lead_pos, lead_n)):
            column.append(values[keep])
        made = [np.concatenate(c) for c in out]
        if len(made[0]):
            kinds = [np.int64, np.int32, np.int64, np.int32, np.int64, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(k)) for m, k in zip(made, kinds)], names=["gram", "pos", "sid", "n", "lead_sid", "lead_pos", "lead_n"])


def _ranked(led: DataFrame) -> DataFrame:
    """``led`` with ``before``, how many earlier prefix shingles of the item others have too, and ``prev``, the last of them.

    The rest of what precedes ``pos`` is shared with none.
    """
    along = Window.partitionBy("sid").orderBy("pos")
    return led.withColumns({"before": F.row_number().over(along) - 1, "prev": F.lag("gram").over(along)})


def _positions_allow(before_a: Column, pa_: Column, na: Column, before_b: Column, pb: Column, nb: Column) -> Column:
    """Length and positional filter for one shared shingle: what may precede it, it, and what may follow must reach the threshold."""
    most = F.least(before_a, before_b) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (most >= needed(na, nb))


# ---------------------------------------------------------------------------------------------------------------- verification
def _cells(grams: np.ndarray) -> bytes:
    """How many shingles fall into each of a power of two of equal hash ranges, about one range for four shingles."""
    bits = max(0, int(len(grams)).bit_length() - 3)
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(grams)])
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def _cells_reach(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Suffix filter: the ranges split both sets alike, so the intersection is at most the sum of the smaller counts."""
    a, b = np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.uint16).astype(np.int64)
    if (a == 65535).any() or (b == 65535).any():
        return True
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(axis=1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(a, b).sum()) >= _needed(na, nb)


def _sets_of(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``sid, cells, grams`` of the ``wanted`` items (``sid, doc_id``), from their texts."""
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            for at in range(0, len(sets), 256):
                some = sets[at:at + 256]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_sid(set_digest(s), seed) for s in some], pa.int64()), pa.array([_cells(s) for s in some], pa.binary()),
                    pa.array([s.tobytes() for s in some], pa.binary())], names=["sid", "cells", "grams"])

    ids = wanted.select("doc_id").distinct()
    small = wanted.count() <= BROADCAST_ROWS
    ids = F.broadcast(ids) if small else ids
    texts = docs.join(ids.select(F.col("doc_id").alias("want")), F.col("doc_id").eqNullSafe(F.col("want"))).select("text")
    found = texts.mapInArrow(run, "sid long, cells binary, grams binary").join(wanted.select("sid"), "sid", "left_semi")
    return found.groupBy("sid").agg(F.first("cells").alias("cells"), F.first("grams").alias("grams"))


def _verified(pairs: DataFrame, docs: DataFrame, items: DataFrame, seed: int, written: Written) -> DataFrame:
    """The pairs ``a, n_a, b, n_b`` that reach the threshold: the suffix filter on small counts first, then the sets, each pair once."""
    wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct().join(items.select("sid", "doc_id"), "sid")
    sets = written.table(_sets_of(docs, written.table(wanted), seed))

    def filtered(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("cells_a", "cells_b", "n_a", "n_b")))
            keep = pa.array([_cells_reach(*row) for row in rows], pa.bool_())
            yield batch.select(["a", "n_a", "b", "n_b"]).filter(keep)

    def checked(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(rows, column):
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("sid").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows

    schema = "a long, n_a int, b long, n_b int"
    near = with_both(pairs, "cells").select("a", "n_a", "b", "n_b", "cells_a", "cells_b").mapInArrow(filtered, schema)
    near = written.table(near)
    links = written.table(with_both(near, "grams").select("a", "b", "grams_a", "grams_b").mapInArrow(checked, "a long, b long"))
    written.drop(sets, near)
    return links


# ---------------------------------------------------------------------------------------------------------------- the join
def _leader_pairs(led: DataFrame) -> DataFrame:
    """For each item the leader that it shares most prefix shingles with, if the filters allow it."""
    rows = led.filter("sid <> lead_sid").filter(_positions_allow(F.col("before"), F.col("pos"), F.col("n"), F.col("lead_pos"), F.col("lead_pos"), F.col("lead_n")))
    counted = rows.groupBy("sid", "n", "lead_sid", "lead_n").agg(F.count("*").alias("k"))
    best = counted.groupBy("sid", "n").agg(F.max(F.struct("k", "lead_sid", "lead_n")).alias("best"))
    return best.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("best.lead_sid").alias("b"), F.col("best.lead_n").alias("n_b"))


def _open_pairs(led: DataFrame, classes: DataFrame, written: Written) -> DataFrame:
    """All candidate pairs of items in different classes that pass the filters.

    A row goes before the join when not even the smallest item of its shingle could reach the threshold with it, or when its shingle has
    a single class left: a group of near copies that is one class by now meets no one, and what differs too much from it meets none of them.
    Two items that share a run of shingles meet at its first one only: at the others both have the same ``prev``, where they have met already.
    """
    at = led.select("gram", "prev", "before", "pos", "sid", "n").join(classes.select(F.col("node").alias("sid"), "label"), "sid", "left")
    at = at.withColumn("label", F.coalesce("label", "sid"))
    least = at.groupBy("gram").agg(F.min("n").alias("least_n"))
    low = F.greatest(F.col("least_n"), F.ceil(F.col("n") * PERCENT / 100))
    able = at.join(least, "gram").filter(F.col("before") + F.col("n") - F.col("pos") >= needed(F.col("n"), low)).drop("least_n")
    able = written.table(able)
    mixed = able.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("gram")
    rows = able.join(mixed, "gram", "left_semi")
    x, y = (rows.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("prev", "before", "pos", "sid", "n", "label")]) for side in ("x", "y"))
    allowed = _positions_allow(*(F.col(f"{c}_{side}") for side in ("x", "y") for c in ("before", "pos", "n")))
    met_before = F.coalesce(F.col("prev_x") == F.col("prev_y"), F.lit(False))
    met = x.join(y, "gram").filter((F.col("sid_x") < F.col("sid_y")) & (F.col("label_x") != F.col("label_y")) & ~met_before & allowed)
    return met.select(F.col("sid_x").alias("a"), F.col("n_x").alias("n_a"), F.col("sid_y").alias("b"), F.col("n_y").alias("n_b")).distinct()


def _item_links(docs: DataFrame, scanned: DataFrame, items: DataFrame, seed: int, written: Written) -> DataFrame:
    levels = _frequencies(scanned)
    postings = _prefixes(docs, levels, seed)
    led = written.table(postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "pos", "sid").mapInArrow(_led, _LED))
    plain, led = led, written.table(_ranked(led))
    written.drop(plain)
    first = _verified(written.table(_leader_pairs(led)), docs, items, seed, written)
    second = _verified(written.table(_open_pairs(led, components(first, written), written)), docs, items, seed, written)
    return written.table(first.unionAll(second))


def _items(scanned: DataFrame, seed: int) -> DataFrame:
    """``sid, n, doc_id`` of each distinct shingle set; ``doc_id`` is the smallest that has it."""
    rows = _with_sid(scanned.filter("digest is not null"), seed)
    return rows.groupBy("sid").agg(F.max("n").cast("int").alias("n"), F.min("doc_id").alias("doc_id"), (F.min("digest") == F.max("digest")).alias("sound"))


def _with_sid(rows: DataFrame, seed: int) -> DataFrame:
    """The 64-bit name of a set: the first bytes of its digest, little end first."""
    pieces = [F.conv(F.hex(F.substring("digest", i, 1)), 16, 10).cast("long") for i in range(1, 9)]
    value = pieces[0]
    for i, piece in enumerate(pieces[1:], 1):
        value = value.bitwiseOR(F.shiftleft(piece, 8 * i))
    return rows.withColumn("sid", value.bitwiseXOR(F.lit(seed).cast("long")))


def near_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents are linked when their shingle sets reach the threshold; ``component_id`` is the smallest id that links reach.  A text
    without words has no shingles and is a component of its own.  Null ids are reached like others but never name a component that has
    another id.  Copies are linked through their common set; repeated rows stay rows.
    """
    written = Written(docs.sparkSession)
    narrow = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = _scan(narrow, written)
    items = written.table(_items(scanned, 0))
    if not items.filter("not sound").isEmpty():
        raise ValueError("two different shingle sets share a 64-bit name")
    links = _item_links(narrow, scanned, items, 0, written)
    classes = components(links, written)
    named = items.join(classes.select(F.col("node").alias("sid"), "label"), "sid", "left").select("sid", "doc_id", F.coalesce("label", "sid").alias("label"))
    named = written.table(named)
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written.table(named.join(lowest, "label").select("sid", "component_id"))
    rows = _with_sid(scanned.filter("part is null"), 0).select("doc_id", F.col("n").alias("n_shingles"), "sid")
    with_words = rows.filter("sid is not null").join(named, "sid").select("doc_id", "n_shingles", "component_id")
    return with_words.unionAll(rows.filter("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group stays, with all its columns.

    Rows without an id stay.  Of several rows with the id that stays, all that share its shingle set remain, as exact copies are not this
    operator's concern.
    """
    written = Written(docs.sparkSession)
    gone = written.table(near_copies(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    carried = Carried(docs)
    return carried.back(carried.frame.join(gone, carried.col(id_col).cast("long") == F.col("gone_id"), "left_anti"))
