"""Pairwise comparison of signatures as a grid of bounded tiles.

Every signature is hashed to one of ``G`` slices and sent to the ``G`` tiles its slice takes part in, so a tile
holds two slices of bounded size whatever the data looks like: no row, label or value can make one tile larger
than another.  A tile compares its rows block-wise and emits pairs, or only the partial aggregate that the caller
asked for (histogram bins, row sums, nearest neighbours), which Spark then merges with an ordinary ``groupBy``.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sigloom.functions.kernels import method_named
from sigloom.model import N_RANKS
from sigloom.session import cut_lineage, is_written, release

_BLOCK_ROWS = 256
_BLOCK_PAIRS = 1 << 20  # pairs that a tile compares at once, whatever its size
_LAID_PAIRS = 1 << 22  # pairs that a tile holds to lay them out, when they leave it
_BATCH_PAIRS = 1 << 18  # pairs of one batch that leaves a tile
_FEW_VALUES = 1 << 16  # distances that a column holds as codes
_FEW_KEYS = 1 << 20  # bins that a tile counts by their number
_SIDE_A, _SIDE_B, _SIDE_BOTH = 0, 1, 2


# ---------------------------------------------------------------- grid

_SLICE_BYTES = 64 << 20
_SLICE_ROWS = 16_384
_TILES_PER_PARTITION = 8


def rows_that_fit(width):
    """Rows of ``width`` doubles that make one slice of a tile: bounded in bytes and in number."""
    return max(1, min(_SLICE_ROWS, _SLICE_BYTES // (8 * max(1, width))))


def slice_count(n_rows, rows_per_tile, parallelism):
    """Slices needed to bound a tile, raised until there are a few tiles for every task slot (while slices stay useful).

    Every further slice ships all rows once more, so tiles are no smaller than memory and parallelism ask for.
    """
    need = max(1, math.ceil(n_rows / rows_per_tile))
    wanted = math.ceil(math.sqrt(4 * parallelism))
    return max(need, min(wanted, max(1, n_rows // 128)))


def _slice_of(col, n):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _triangle(df, id_col, n):
    """Send each row to the tiles (i, j), i <= j, that contain its slice."""
    mine, other = F.col("_slice"), F.col("_other")
    low, high = F.least(mine, other), F.greatest(mine, other)
    return (
        df.withColumn("_slice", _slice_of(F.col(id_col), n))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("_tile", (high.cast("long") * (high + 1) / 2).cast("long") + low)
        .withColumn("_side", F.when(mine == other, _SIDE_BOTH).when(mine < other, _SIDE_A).otherwise(_SIDE_B))
        .drop("_slice", "_other")
    )


def _rectangle(refs, queries, id_col, n_ref, n_query):
    left = (
        refs.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
        .withColumn("_tile", _slice_of(F.col(id_col), n_ref).cast("long") * n_query + F.col("_q"))
        .withColumn("_side", F.lit(_SIDE_A)).drop("_q")
    )
    right = (
        queries.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_ref - 1))))
        .withColumn("_tile", F.col("_r").cast("long") * n_query + _slice_of(F.col(id_col), n_query))
        .withColumn("_side", F.lit(_SIDE_B)).drop("_r")
    )
    return left.unionByName(right)


def _spread(tiled, n_tiles, parallelism):
    """Give every tile its own partition while they are few; afterwards a bounded number of tiles share one."""
    parts = int(min(n_tiles, max(64 * parallelism, 256, n_tiles // _TILES_PER_PARTITION)))
    return tiled.withColumn("_part", F.pmod(F.col("_tile"), F.lit(parts)).cast("int")).repartitionById(parts, "_part")


# ---------------------------------------------------------------- tile contents

class _Rows:
    """The rows of one side of a tile as arrays."""

    def __init__(self, table, spec):
        self.n = table.num_rows
        self.ids = table.column(spec["id"]).combine_chunks()
        if isinstance(self.ids, pa.ChunkedArray):
            self.ids = pa.concat_arrays(self.ids.chunks) if self.ids.num_chunks else pa.array([], self.ids.type)
        self.order = np.asarray(table.column(spec["order"]).to_numpy())
        self.lengths, self.values = _flatten(table.column("sig")) if spec["method"] else (np.ones(self.n, int), None)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.missing = np.asarray(table.column("sig").is_null()) if spec["method"] else np.zeros(self.n, bool)
        self.weight = table.column("weight").to_numpy() if spec["weighted"] else None
        self.group = table.column(spec["within"]).to_pylist() if spec["within"] else None
        self.lineage = table.column("lineage").to_pylist() if spec["lineage"] else None

    def matrix(self, rows, tail):
        """Rows of one common length as a dense matrix."""
        width = self.lengths[rows[0]]
        if tail == "sets":
            return [self.values[self.starts[r]:self.starts[r] + self.lengths[r]] for r in rows]
        out = self.values[self.starts[rows][:, None] + np.arange(width)[None, :]]
        return out[:, :-1] if tail == "skip_last" else out


def _flatten(column):
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(chunk, pa.ChunkedArray):
        chunk = pa.concat_arrays(chunk.chunks) if chunk.num_chunks else pa.array([], chunk.type)
    lengths = np.asarray(chunk.value_lengths().fill_null(0)).astype(np.int64)
    values = chunk.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return lengths, values


def _lineage_codes(left, right):
    """Integer codes per rank, shared by both sides; -1 is a missing rank, and rank 0 defaults to equal."""
    coded = np.full((2, max(len(left), len(right)), N_RANKS), -1, dtype=np.int64)
    known = np.zeros((2, coded.shape[1]), dtype=bool)
    tables = [{} for _ in range(N_RANKS)]
    for side, rows in enumerate((left, right)):
        for i, lineage in enumerate(rows):
            if lineage is None:
                continue
            known[side, i] = True
            for rank, taxon in enumerate(lineage[:N_RANKS]):
                taxon = "" if taxon is None and rank == 0 else taxon
                if taxon is not None:
                    coded[side, i, rank] = tables[rank].setdefault(taxon, len(tables[rank]))
    return (coded[0, :len(left)], known[0, :len(left)]), (coded[1, :len(right)], known[1, :len(right)])


def _relations(a, b):
    """Deepest common rank of every row pair, -1 where either side has no lineage."""
    (codes_a, known_a), (codes_b, known_b) = a, b
    relation = np.full((len(codes_a), len(codes_b)), -1, dtype=np.int32)
    open_ = known_a[:, None] & known_b[None, :]
    for rank in range(N_RANKS):
        ca, cb = codes_a[:, rank], codes_b[:, rank]
        if not (ca >= 0).any() or not (cb >= 0).any():
            continue  # no pair has this rank on both sides
        same = ca[:, None] == cb[None, :]
        if (ca >= 0).all() and (cb >= 0).all():
            open_ &= same
            np.copyto(relation, rank, where=open_)
        else:
            both = (ca >= 0)[:, None] & (cb >= 0)[None, :]
            same &= both
            np.copyto(relation, rank, where=open_ & same)
            open_ &= ~both | same
    return relation


# ---------------------------------------------------------------- tile evaluation

def _compare(left, right, same_side, spec):
    """Yield ``(i, j, relation, dist)`` index and value arrays for the wanted pairs of one tile."""
    for part, used, wanted, relation, dist in _blocks(left, right, same_side, spec):
        i, j = np.nonzero(wanted) if not spec.get("by_column") else np.nonzero(wanted.T)[::-1]
        if len(i):
            yield part[i], used[j], None if relation is None else relation[i, j], dist[i, j]


def _blocks(left, right, same_side, spec):
    """Yield ``(rows, columns, wanted, relation, dist)`` of blocks of a tile, the last three as matrices.

    The relation is known before the distance, and only rows with at least one wanted partner reach the kernel.
    """
    codes = _lineage_codes(left.lineage, right.lineage) if spec["lineage"] else None
    prepare, block = (None, None)
    if spec["method"]:
        method = method_named(spec["method"])
        prepare, block = method.bind(spec["theta"], spec["scale"], spec["common_format"], spec["sketch_size"])
        tail = "sets" if method.sets else "skip_last" if spec["length_tail"] and method.profile_tail == "skip" else "use"
    for rows, cols in _row_groups(left, right, spec):
        ready = None
        if spec["method"]:
            ready = prepare(right.matrix(cols, tail)) if _comparable(left, right, rows, cols, method.sets) else None
        step = max(1, min(_BLOCK_ROWS, _BLOCK_PAIRS // len(cols)))
        step -= step % 8 if step > 8 else 0
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            wanted = np.ones((len(part), len(cols)), dtype=bool)
            if same_side:
                oa, ob = left.order[part][:, None], right.order[cols][None, :]
                wanted = (oa <= ob) if spec["include_self"] else (oa < ob)
            relation = None
            if codes:
                (ca, ka), (cb, kb) = codes
                relation = _relations((ca[part], ka[part]), (cb[cols], kb[cols]))
                if spec["only"] is not None:
                    wanted &= relation == spec["only"]
            keep_r, keep_c = wanted.any(axis=1), wanted.any(axis=0)
            if not keep_r.any():
                continue
            part, wanted = part[keep_r], wanted[np.ix_(keep_r, keep_c)]
            used = cols[keep_c]
            if relation is not None:
                relation = relation[np.ix_(keep_r, keep_c)]
            if not spec["method"]:
                dist = np.zeros(wanted.shape)
            elif ready is None:
                dist = np.full(wanted.shape, np.nan)
                if spec["low"] is not None or spec["high"] is not None or spec["drop_incomparable"]:
                    continue
            else:
                partners = [ready[c] for c in np.flatnonzero(keep_c)] if isinstance(ready, list) else ready[keep_c]
                dist = block(prepare(left.matrix(part, tail)), partners)
                wanted &= ~np.isnan(dist)
                if spec["low"] is not None:
                    wanted &= dist >= spec["low"]
                if spec["high"] is not None:
                    wanted &= dist <= spec["high"]
            yield part, used, wanted, relation, dist


def _comparable(left, right, rows, cols, sets):
    if sets:
        return not left.missing[rows[0]] and not right.missing[cols[0]]
    width = left.lengths[rows[0]]
    return width > 0 and width == right.lengths[cols[0]] and not left.missing[rows[0]] and not right.missing[cols[0]]


def _row_groups(left, right, spec):
    """Split a tile so that every block has one vector length per side (and one group when pairs stay within one)."""
    sets = bool(spec["method"]) and method_named(spec["method"]).sets

    def keyed(side):
        buckets = {}
        for i in range(side.n):
            group = side.group[i] if side.group is not None else None
            width = 0 if sets else int(side.lengths[i])
            buckets.setdefault((group, bool(side.missing[i]), width), []).append(i)
        return {k: np.asarray(v) for k, v in buckets.items()}

    cols = keyed(right)
    for (group, missing, width), rows in keyed(left).items():
        for (other_group, other_missing, other_width), other in cols.items():
            if group == other_group:
                yield rows, other


def _tile_sides(batches, spec):
    table = pa.Table.from_batches(list(batches))
    if spec.get("by_column"):
        table = table.take(pc.sort_indices(table, sort_keys=[(spec["order"], "ascending")]))
    side = table.column("_side").to_numpy()
    if (side == _SIDE_BOTH).any():
        rows = _Rows(table, spec)
        return rows, rows, True
    a, b = table.filter(pa.array(side == _SIDE_A)), table.filter(pa.array(side == _SIDE_B))
    return _Rows(a, spec), _Rows(b, spec), False


def _oriented(left, right, i, j, spec):
    """Ids in input order (earlier first) for a triangle, (reference, query) for a rectangle."""
    ids_a, ids_b = left.ids.take(pa.array(i)), right.ids.take(pa.array(j))
    oa, ob = left.order[i], right.order[j]
    if spec["oriented"]:
        swap = oa > ob
        if swap.any():
            mask = pa.array(swap)
            ids_a, ids_b = _choose(mask, ids_b, ids_a), _choose(mask, ids_a, ids_b)
            oa, ob = np.where(swap, ob, oa), np.where(swap, oa, ob)
    return ids_a, ids_b, oa, ob


def _choose(mask, yes, no):
    return pc.if_else(mask, yes, no)


def _laid_out(dist):
    """Positions in which pairs are written smallest, None for the order in which they were compared.

    That order has one column of ids in runs and the other one in a cycle, which costs next to nothing, and codes for few distances.  Many distances are
    written as they are, so where enough pairs share one (to a millionth) it is smaller to have the distances in runs and the ids as codes.
    """
    n = len(dist)
    shift = n.bit_length()
    millionths = np.clip(np.rint(np.nan_to_num(dist) * 1e6), -(1 << 39), 1 << 39).astype(np.int64)
    if len(np.unique(millionths[::max(1, n >> 12)])) <= 1 << 10:
        return None
    keyed = np.sort((millionths << shift) | np.arange(n))
    values = 1 + np.count_nonzero(np.diff(keyed >> shift))
    return keyed & ((1 << shift) - 1) if _FEW_VALUES < values < n // 2 else None


def _emit_pairs(spec):
    to_lay = spec.get("laid_out", True)
    spec = {**spec, "by_column": to_lay}

    def laid_out(left, right, found):
        i, j, relation, dist = (None if x[0] is None else np.concatenate(x) for x in zip(*found))
        at = _laid_out(dist) if to_lay and spec["method"] else None
        for start in range(0, len(i), _BATCH_PAIRS):
            some = slice(start, start + _BATCH_PAIRS) if at is None else at[start:start + _BATCH_PAIRS]
            ids_a, ids_b, oa, ob = _oriented(left, right, i[some], j[some], spec)
            columns = [ids_a, ids_b]
            if spec["carry_order"]:
                columns += [pa.array(oa), pa.array(ob)]
            if spec["lineage"]:
                columns.append(pa.array(relation[some], pa.int32()))
            if spec["method"]:
                columns.append(pa.array(dist[some], pa.float64(), mask=np.isnan(dist[some])))
            yield pa.RecordBatch.from_arrays(columns, names=spec["names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _tile_sides(batches, spec)
        if not left.n or not right.n:
            return
        found, n = [], 0
        for i, j, relation, dist in _compare(left, right, same, spec):
            found, n = [*found, (i.astype(np.int32), j.astype(np.int32), relation, dist)], n + len(i)
            if n >= _LAID_PAIRS or not to_lay:
                yield from laid_out(left, right, found)
                found, n = [], 0
        if found:
            yield from laid_out(left, right, found)
    return run


def _emit_histogram(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _tile_sides(batches, spec)
        totals = {}
        if left.n and right.n:
            for rows, cols, wanted, relation, dist in _blocks(left, right, same, spec):
                keep = wanted & (dist >= 0)
                every = bool(keep.all())
                held = lambda matrix: matrix.reshape(-1) if every else matrix[keep]
                scaled = held(dist) / spec["bin_width"]
                key = np.floor(scaled + 0.5 if spec["round_bins"] else scaled).astype(np.int64) * (N_RANKS + 1)
                if relation is not None:
                    key += held(relation) + 1
                weight = None
                if spec["weighted"]:
                    weight = held(left.weight[rows][:, None] * (np.ones((1, len(cols))) if spec["rectangle"] else right.weight[cols][None, :]))
                if not len(key):
                    continue
                low, high = int(key.min()), int(key.max())
                if high - low <= _FEW_KEYS:
                    unique, inverse = np.arange(low, high + 1), key - low
                else:
                    unique, inverse = np.unique(key, return_inverse=True)
                found, sums = np.bincount(inverse, minlength=len(unique)), np.bincount(inverse, weights=weight, minlength=len(unique))
                for u, w in zip(unique[found > 0].tolist(), sums[found > 0].tolist()):
                    totals[u] = totals.get(u, 0.0) + w
        if totals:
            keys = np.fromiter(totals.keys(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys // (N_RANKS + 1)), pa.array((keys % (N_RANKS + 1) - 1).astype(np.int32)),
                 pa.array(np.fromiter(totals.values(), np.float64))],
                names=spec["names"])
    return run


def _emit_row_sums(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _tile_sides(batches, spec)
        if not left.n or not right.n:
            return
        sums_l, hits_l = np.zeros(left.n), np.zeros(left.n, np.int64)
        sums_r, hits_r = (sums_l, hits_l) if same else (np.zeros(right.n), np.zeros(right.n, np.int64))
        for i, j, _, dist in _compare(left, right, same, spec):
            sums_l += np.bincount(i, weights=dist, minlength=left.n)
            hits_l += np.bincount(i, minlength=left.n)
            sums_r += np.bincount(j, weights=dist, minlength=right.n)
            hits_r += np.bincount(j, minlength=right.n)
        for side, sums, hits in [(left, sums_l, hits_l)] + ([] if same else [(right, sums_r, hits_r)]):
            yield pa.RecordBatch.from_arrays([side.ids, pa.array(sums), pa.array(hits)], names=spec["names"])
    return run


def _nearest_of(me, you, dist, order):
    """Positions of the smallest ``(dist, order)`` of every ``me``.  Only what ties with the smallest distance is sorted."""
    at = np.arange(len(dist))
    if not np.isnan(dist).any():
        smallest = np.full(me.max(initial=-1) + 1, np.inf)
        np.minimum.at(smallest, me, dist)
        at = np.flatnonzero(dist == smallest[me])
    at = at[np.lexsort((order[you[at]], dist[at], me[at]))]
    return at[np.r_[True, me[at][1:] != me[at][:-1]]] if len(at) else at


def _emit_nearest(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _tile_sides(batches, spec)
        if not left.n or not right.n:
            return
        best = {0: {}, 1: {}}
        for i, j, _, dist in _compare(left, right, same, spec):
            directions = [(0, i, j, right)] if spec["rectangle"] else [(0, i, j, right), (0 if same else 1, j, i, left)]
            for side, me, you, other in directions:
                for p in _nearest_of(me, you, dist, other.order):
                    found = (float(dist[p]), other.order[you[p]], int(you[p]))
                    held = best[side].get(int(me[p]))
                    if held is None or found < held:
                        best[side][int(me[p])] = found
        for side, mine, theirs in ((0, left, right), (1, right, left)):
            if best[side]:
                rows = list(best[side])
                found = [best[side][r] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [mine.ids.take(pa.array(rows)), theirs.ids.take(pa.array([f[2] for f in found])),
                     pa.array(np.asarray([f[1] for f in found])), pa.array([f[0] for f in found])],
                    names=spec["names"])
    return run


def _forest_edges(u, v, n):
    """Indices of the edges of the minimum spanning forest, for edges in increasing order over nodes ``0 … n-1``."""
    label, kept, left = np.arange(n), [], np.arange(len(u))
    while len(left):
        cu, cv = label[u[left]], label[v[left]]
        left = left[cu != cv]
        cu, cv = label[u[left]], label[v[left]]
        best = np.full(n, len(u))
        np.minimum.at(best, cu, left)
        np.minimum.at(best, cv, left)
        mine = np.flatnonzero(best < len(u))
        if not len(mine):
            break
        edge = best[mine]
        kept.append(np.unique(edge))
        parent = np.arange(n)
        parent[mine] = np.where(label[u[edge]] == mine, label[v[edge]], label[u[edge]])
        mutual = mine[(parent[parent[mine]] == mine) & (mine < parent[mine])]
        parent[mutual] = mutual
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _smallest(owner, dist, order, k):
    """Positions of the ``k`` smallest ``(dist, order)`` of every owner."""
    at = np.lexsort((order, dist, owner))
    first = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[rank < k]


def _emit_topk(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, _ = _tile_sides(batches, spec)
        if not left.n or not right.n:
            return
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a, b, _, dist in _compare(left, right, False, spec):
            known = ~np.isnan(dist)
            i, j, d = np.concatenate((i, a[known])), np.concatenate((j, b[known])), np.concatenate((d, dist[known]))
            keep = _smallest(j, d, left.order[i], spec["k"])  # what a block leaves out, k others of its query have beaten
            i, j, d = i[keep], j[keep], d[keep]
        yield pa.RecordBatch.from_arrays([right.ids.take(pa.array(j)), left.ids.take(pa.array(i)), pa.array(left.order[i]), pa.array(d)], names=spec["names"])
    return run


def _emit_forest(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _tile_sides(batches, spec)
        if not left.n or not right.n:
            return
        shift, n = (0, left.n) if same else (left.n, left.n + right.n)
        ids = np.asarray(left.ids) if same else np.concatenate((np.asarray(left.ids), np.asarray(right.ids)))
        order = left.order if same else np.concatenate((left.order, right.order))
        u, v, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for i, j, _, dist in _compare(left, right, same, spec):
            known = ~np.isnan(dist)
            i, j = i[known], j[known] + shift
            swap = order[i] > order[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            u, v, d = np.concatenate((u, i)), np.concatenate((v, j)), np.concatenate((d, dist[known]))
            rank = np.lexsort((ids[v], ids[u], d))
            keep = rank[_forest_edges(u[rank], v[rank], n)]
            u, v, d = u[keep], v[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(d)], names=spec["names"])
    return run


# ---------------------------------------------------------------- public operators

class PairJob:
    """A pairwise comparison described once and read out in several shapes.

    ``sigs`` is compared with itself (each unordered pair once) or, when ``queries`` is given, every row of
    ``sigs`` with every query.  Without ``rows_per_tile`` the tile size follows from the vector width; giving it together
    with ``n_rows`` (and ``n_queries``) saves the measuring pass.
    """

    def __init__(self, sigs: DataFrame, method=None, *, queries=None, theta=None, scale="none", id_col="id",
                 order_col=None, low=None, high=None, only=None, include_self=False, within=None,
                 common_format=False, length_tail=False, drop_incomparable=False, sketch_size=None, rows_per_tile=None,
                 n_rows=None, n_queries=None):
        if method:
            method = method_named(method).name
        self.spark = sigs.sparkSession
        self.id_col, self.order_col = id_col, order_col or id_col
        self.queries = queries
        wanted = [id_col] + ([order_col] if order_col and order_col != id_col else [])
        wanted += ["sig"] if method else []
        self.has_lineage = "lineage" in sigs.columns
        self.has_weight = "weight" in sigs.columns
        wanted += ["lineage"] if self.has_lineage else []
        wanted += ["weight"] if self.has_weight else []
        wanted += [within] if within else []
        self.frame = sigs.select(*dict.fromkeys(wanted))
        self.query_frame = queries.select(*[c for c in dict.fromkeys(wanted)]) if queries is not None else None
        self.parallelism = self.spark.sparkContext.defaultParallelism
        self.written = [is_written(sigs), queries is None or is_written(queries)]
        self.tables = []
        self.rows_per_tile = rows_per_tile
        self.n_rows, self.n_queries = n_rows, n_queries
        self.spec = dict(
            id=id_col, order=self.order_col, method=method, theta=theta, scale=scale, low=low, high=high, only=only,
            include_self=include_self, within=within, common_format=common_format, length_tail=length_tail,
            drop_incomparable=drop_incomparable, sketch_size=sketch_size, lineage=self.has_lineage, weighted=False,
            rectangle=queries is not None, oriented=queries is None, carry_order=self.order_col != id_col)

    def _tiles(self, weighted=False):
        frame, queries = self.frame, self.query_frame
        if self.has_weight and not weighted:
            frame = frame.drop("weight")
            queries = queries.drop("weight") if queries is not None else None
        frame, n, rows = self._measured(frame, self.n_rows, self.written[0])
        if queries is None:
            slices = slice_count(n, rows, self.parallelism)
            return _spread(_triangle(frame, self.id_col, slices), slices * (slices + 1) // 2, self.parallelism)
        queries, m, _ = self._measured(queries, self.n_queries, self.written[1])
        q = max(1, math.ceil(m / rows))
        r = max(1, math.ceil(n / rows), min(2 * self.parallelism, n // 128))
        return _spread(_rectangle(frame, queries, self.id_col, r, q), r * q, self.parallelism)

    def _measured(self, frame, known, written):
        """The signatures with their number and the rows per slice.

        Unless both are given they are counted, and for that the (small) signature table is written first: what it is made from is
        read once, not once to count and once to compare.
        """
        if known is not None and self.rows_per_tile is not None:
            return frame, known, self.rows_per_tile
        if not written:
            frame = cut_lineage(frame)
            self.tables.append(frame)
        width = F.max(F.size("sig")) if self.spec["method"] else F.lit(1)
        n, widest = frame.agg(F.count("*"), width).first()
        return frame, n, self.rows_per_tile or rows_that_fit(widest or 1)

    def release(self):
        """Delete the signature tables that this job has written, once its results are stored."""
        release(*self.tables)
        self.tables = []

    def _run(self, emitter, schema, weighted=False, **extra):
        spec = {**self.spec, "weighted": weighted, "names": schema.fieldNames(), **extra}
        return self._tiles(weighted).groupBy("_part", "_tile").applyInArrow(emitter(spec), schema)

    def _id_type(self):
        return self.frame.schema[self.id_col].dataType

    def write(self):
        """Write the signatures, so that they are made once, and count them."""
        if not self.written[0]:
            self.frame = cut_lineage(self.frame)
            self.tables.append(self.frame)
            self.written[0] = True
        return self.frame.count()

    def plain_method(self):
        """The method of a job that compares all vectors of one table as they are, None for any other job."""
        spec = self.spec
        odd = [spec[x] for x in ("theta", "low", "high", "only", "include_self", "within", "common_format", "length_tail", "rectangle")]
        plain = spec["method"] and spec["scale"] == "none" and self.order_col == self.id_col and not method_named(spec["method"]).sets
        return spec["method"] if plain and all(x in (None, False) for x in odd) else None

    def pairs(self, laid_out=True):
        """``id_a, id_b[, ord_a, ord_b][, relation][, dist]``; incomparable pairs have a NULL distance.

        ``laid_out`` is for pairs that are written as they come: tiles send them in an order that takes little space.  Pairs that are sorted anyway do without.
        """
        fields = [T.StructField("id_a", self._id_type()), T.StructField("id_b", self._id_type())]
        if self.spec["carry_order"]:
            order_type = self.frame.schema[self.order_col].dataType
            fields += [T.StructField("ord_a", order_type), T.StructField("ord_b", order_type)]
        if self.has_lineage:
            fields.append(T.StructField("relation", T.IntegerType()))
        if self.spec["method"]:
            fields.append(T.StructField("dist", T.DoubleType()))
        return self._run(_emit_pairs, T.StructType(fields), laid_out=laid_out)

    def histogram(self, bin_width=0.001, weighted=False, round_bins=None):
        """``bin, relation, weight`` summed over all pairs; no pair leaves its tile."""
        schema = T.StructType([T.StructField("bin", T.LongType()), T.StructField("relation", T.IntegerType()),
                               T.StructField("weight", T.DoubleType())])
        rounding = self.queries is not None if round_bins is None else round_bins
        partial = self._run(_emit_histogram, schema, weighted=weighted, bin_width=bin_width, round_bins=rounding)
        return partial.groupBy("bin", "relation").agg(F.sum("weight").alias("weight"))

    def search_topk(self, k):
        """``query_id, rank, id, dist``: the ``k`` closest rows of every query, the earlier row on equal distances.

        A tile sends at most ``k`` rows per query, so the result and what is shuffled for it do not grow with the pairs.
        """
        if self.queries is None:
            raise ValueError("a top-k search needs queries")
        order_type = self.frame.schema[self.order_col].dataType
        schema = T.StructType([T.StructField("query_id", self._id_type()), T.StructField("id", self._id_type()), T.StructField("ord", order_type), T.StructField("dist", T.DoubleType())])
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "ord"))
        found = self._run(_emit_topk, schema, k=k)
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")

    def forest(self):
        """``id_a, id_b, dist``: of each tile only the edges of its own minimum spanning forest.

        An edge that a tile leaves out is the largest of a cycle, so the minimum spanning tree of all pairs is among these edges, and their
        number falls from the square of the rows to the rows times the slices.
        """
        schema = T.StructType([T.StructField("id_a", self._id_type()), T.StructField("id_b", self._id_type()), T.StructField("dist", T.DoubleType())])
        return self._run(_emit_forest, schema)

    def row_sums(self):
        """``id, dist_sum, n_pairs`` of every row against all its partners."""
        schema = T.StructType([T.StructField("id", self._id_type()), T.StructField("dist_sum", T.DoubleType()),
                               T.StructField("n_pairs", T.LongType())])
        partial = self._run(_emit_row_sums, schema)
        return partial.groupBy("id").agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n_pairs").alias("n_pairs"))

    def nearest(self):
        """``id, nearest_id, dist``: the closest other row, the earliest one on equal distances."""
        schema = T.StructType([T.StructField("id", self._id_type()), T.StructField("nearest_id", self._id_type()),
                               T.StructField("nearest_ord", self.frame.schema[self.order_col].dataType),
                               T.StructField("dist", T.DoubleType())])
        found = self._run(_emit_nearest, schema)
        best = F.min(F.struct("dist", "nearest_ord", "nearest_id")).alias("best")
        return found.groupBy("id").agg(best).select("id", "best.nearest_id", "best.dist")
