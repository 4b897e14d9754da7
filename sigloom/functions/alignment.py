"""Gap-affine alignment of many short sequence pairs at once.

Costs are minimised first; among alignments of equal cost the one with more identities, then the shorter one, wins.
The three criteria are packed into one additive integer, so a plain minimum decides all of them.  End-to-end alignments fill a band of diagonals that grows
until the cost proves it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
SUBSTITUTION, GAP_OPEN, GAP_EXTEND, LEADING_GAP = 2, 3, 1, 1
# ----------------------------------------------------------------------------------------------

_FAR = np.int64(1) << 61
_CELLS = 1 << 16  # cells of one row of the tables that are filled side by side: what a core's cache holds
_LONGEST = 1 << 19  # bases of both sequences together: costs then stay below 2^21, identities and lengths below 2^20
_CODES = np.full(256, 4, dtype=np.uint8)
for _code, _letter in enumerate("ACGT"):
    _CODES[ord(_letter)] = _code


def encode(text):
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]


def _pad(sequences, width):
    out = np.full((len(sequences), width), 255, dtype=np.uint8)
    for i, s in enumerate(sequences):
        out[i, :len(s)] = s
    return out


def align_block(queries, targets, free_target_ends):
    """``cost, identities, length, end`` of every query/target pair; with free ends the query may lie anywhere in the target."""
    n = len(queries)
    nq, nt = np.array([len(q) for q in queries]), np.array([len(t) for t in targets])
    if (nq + nt).max(initial=0) >= _LONGEST:
        raise ValueError(f"cannot align sequences of {_LONGEST} bases or more in all")
    # cost, missing identities and length share a number whose parts are as wide as these sequences need; rows of cells lie pair beside pair
    longest, most = int((nq + nt).max(initial=0)), int(np.minimum(nq, nt).max(initial=0))
    base = 1 << (longest + 1).bit_length()
    unit = base << ((most + 1).bit_length() + 1)
    short = (2 * longest + 16) * unit < 1 << 30
    kind, far = (np.int32, np.int32(1 << 30)) if short else (np.int64, _FAR)
    q, t = (np.ascontiguousarray(_pad(x, max(1, m.max(initial=0))).T) for x, m in ((queries, nq), (targets, nt)))
    known = t < 4
    columns = np.arange(t.shape[0] + 1, dtype=np.int64)[:, None]
    step_open, step_more, step_lead = (kind(c * unit + 1) for c in (GAP_OPEN, GAP_EXTEND, LEADING_GAP))
    substitution, match = kind(SUBSTITUTION * unit + 1), kind(1 - base)
    slope = (columns * int(step_more)).astype(kind)
    onward = (slope[1:] + (step_open - step_more)).astype(kind)
    row = np.broadcast_to(columns * 0 if free_target_ends else columns * int(step_lead), (len(columns), n)).astype(kind)
    vertical, fresh, other, reach = np.full_like(row, far), np.empty_like(row), np.empty_like(row), np.empty_like(row)
    final, end = np.full(n, far, np.int64), np.zeros(n, np.int64)

    def settle(done, row):
        if not done.any():
            return
        if free_target_ends:
            masked = np.where(columns <= nt[done], row[:, done], far)
            end[done] = masked.argmin(axis=0)
            final[done] = masked.min(axis=0)
        else:
            end[done] = nt[done]
            final[done] = row[nt[done], done]

    settle(nq == 0, row)
    for i in range(int(nq.max(initial=0))):
        np.add(row, step_open, out=other)
        vertical += step_more
        np.minimum(vertical, other, out=vertical)
        diagonal = np.where((t == q[i]) & known, match, substitution)
        diagonal += row[:-1]
        fresh[0] = (i + 1) * int(step_lead)
        np.minimum(diagonal, vertical[1:], out=fresh[1:])
        # a horizontal gap ending at j starts at the best k < j: a running minimum once the extension cost is taken out
        np.subtract(fresh, slope, out=other)
        np.minimum.accumulate(other, axis=0, out=reach)
        np.add(reach[:-1], onward, out=diagonal)
        np.minimum(fresh[1:], diagonal, out=fresh[1:])
        row, fresh = fresh, row
        settle(nq == i + 1, row)
    cost = (final + unit // 2) // unit
    rest = final - cost * unit
    identities = -(rest // base)
    return cost, identities, rest + identities * base, end


_FIRST_BAND = 32
_TIDY = 16  # rows after which cells beyond the band's proof are closed


def _band(queries, targets, half):
    """``cost, identities, length, proven`` of end-to-end alignments that stay within ``half`` diagonals of the corner diagonals.

    A path that leaves the band has at least ``|difference of lengths| + 2 (half + 1)`` gap bases of cost 1 or more; whatever costs less is the
    best of all alignments, ties included.  Cost, missing identities and length share a number whose parts are as wide as these sequences need.
    """
    n = len(queries)
    nq, nt = np.array([len(x) for x in queries], np.int64), np.array([len(x) for x in targets], np.int64)
    shift = nt - nq
    low, high = np.maximum(np.minimum(0, shift) - half, -nq), np.minimum(np.maximum(0, shift) + half, nt)
    whole = (low == -nq) & (high == nt)
    width = int((high - low).max()) + 1
    most = int(np.minimum(nq, nt).max())
    length_bits = int((nq + nt).max() + 1).bit_length()
    cost_unit = 1 << (length_bits + int(most).bit_length())
    cap = np.where(whole, SUBSTITUTION * np.maximum(nq, nt) + GAP_OPEN + nq + nt + 1, np.abs(shift) + 2 * (half + 1))
    if int(cap.max() + 8 * _TIDY) * cost_unit >= 1 << 61:
        raise OverflowError("these sequences differ too much for their length to be aligned")
    far, identity, start = np.int64(1 << 61), np.int64(1 << length_bits), np.int64(most << length_bits)
    step_open, step_more, step_lead = (np.int64(c * cost_unit + 1) for c in (GAP_OPEN, GAP_EXTEND, LEADING_GAP))
    substitution, match = np.int64(SUBSTITUTION * cost_unit + 1), np.int64(1) - identity
    cells = np.arange(width, dtype=np.int64)
    column = low[:, None] + cells  # column of each cell in row 0; in row i it lies i further
    inside = cells <= (high - low)[:, None]
    ragged = not inside.all()
    # the letter of a cell in row i is the target's letter before its column
    pad = width + int(nq.max()) + 1
    letters = np.full((n, pad + int(nt.max()) + pad), 5, np.uint8)
    for p, t in enumerate(targets):
        letters[p, pad:pad + len(t)] = t
    flat, place = letters.ravel(), np.arange(n)[:, None] * letters.shape[1] + pad + column - 1
    row = np.where(inside & (column >= 0) & (column <= nt[:, None]), start + column * step_lead, far)
    vertical = np.full_like(row, far)
    slope, limit = cells * step_more, (cap * cost_unit)[:, None]
    final = np.full(n, far)
    inner = range(int((-low).max()) + 1, int((nt - low).min()) - width + 2)  # rows whose band meets neither end of the target
    done = nq == 0
    final[done] = row[done, -low[done] + nt[done]]
    for i in range(1, int(nq.max()) + 1):
        letter = np.array([q[i - 1] if i <= len(q) else 6 for q in queries], np.uint8)[:, None] if n > 1 else queries[0][i - 1]
        same = (flat[place + i] == letter) & (letter < 4)
        fresh = row + np.where(same, match, substitution)
        vertical[:, :-1] = np.minimum(row[:, 1:] + step_open, vertical[:, 1:] + step_more)
        vertical[:, -1] = far
        np.minimum(fresh, vertical, out=fresh)
        if i not in inner:
            at = column + i
            fresh[at == 0] = start + i * step_lead
            outside = ~inside | (at < 0) | (at > nt[:, None])
            fresh[outside] = far
        elif ragged:
            fresh[~inside] = far
        reach = np.minimum.accumulate(fresh - slope, axis=1)
        fresh[:, 1:] = np.minimum(fresh[:, 1:], reach[:, :-1] + slope[1:] + (step_open - step_more))
        if i not in inner:
            fresh[outside] = far
        elif ragged:
            fresh[~inside] = far
        if i % _TIDY == 0:
            fresh[fresh >= limit] = far
            np.minimum(vertical, far, out=vertical)
        row = fresh
        ended = nq == i
        if ended.any():
            final[ended] = row[ended, (shift - low)[ended]]
        if i % 256 == 0 and not (row < far).any():
            break  # nothing within the band can be cheap enough
    proven = final < np.minimum(limit[:, 0], far)
    rest = final & np.int64(cost_unit - 1)
    return np.where(proven, final // cost_unit, 0), most - (rest >> length_bits), rest & (identity - 1), proven | whole


def align_within_bands(queries, targets):
    """``cost, identities, length`` end to end: the band is doubled until the cost proves it, so work grows with length times distance."""
    n = len(queries)
    out = np.zeros((3, n), dtype=np.int64)
    lengths = [max(len(q), len(t)) for q, t in zip(queries, targets)]
    narrow = sorted((i for i in range(n) if lengths[i] <= 2 * _FIRST_BAND), key=lambda i: (len(targets[i]), len(queries[i])))
    step = max(1, _CELLS // (2 * _FIRST_BAND + 1))
    for start in range(0, len(narrow), step):  # the full table is no wider than the first band
        rows = narrow[start:start + step]
        out[:, rows] = align_block([queries[i] for i in rows], [targets[i] for i in rows], False)[:3]
    todo, half = [i for i in range(n) if lengths[i] > 2 * _FIRST_BAND], _FIRST_BAND
    while todo:
        todo.sort(key=lambda i: (len(queries[i]), len(targets[i])))
        left, start = [], 0
        while start < len(todo):
            stop, size = start + 1, 0
            while stop < len(todo) and (stop - start + 1) * (2 * half + abs(len(targets[todo[stop]]) - len(queries[todo[stop]])) + len(targets[todo[stop]])) < _CELLS:
                stop += 1
            rows = todo[start:stop]
            *found, proven = _band([queries[i] for i in rows], [targets[i] for i in rows], half)
            out[:, rows] = found
            left += [i for i, ok in zip(rows, proven) if not ok]
            start = stop
        todo, half = left, half * 2
    return out


def align_many(queries, targets, free_target_ends=False):
    """``cost, identities, length, end`` over any number of pairs, similar sizes together and a bounded number of cells at a time.

    End to end the band grows with the distance; with free ends every place of the target counts, and the full table is filled.
    """
    n = len(queries)
    if not free_target_ends:
        return np.vstack([align_within_bands(queries, targets), np.array([[len(t) for t in targets]], dtype=np.int64).reshape(1, n)])
    out = np.zeros((4, n), dtype=np.int64)
    order = sorted(range(n), key=lambda i: (len(targets[i]), len(queries[i])))
    start = 0
    while start < n:
        stop = start + 1
        while stop < n and (stop - start) * (len(targets[order[stop]]) + 1) < _CELLS:
            stop += 1
        rows = order[start:stop]
        out[:, rows] = align_block([queries[i] for i in rows], [targets[i] for i in rows], free_target_ends)
        start = stop
    return out


def edit_identity(a, b):
    """Struct ``cost, identities, length`` of the best end-to-end alignment of two sequences."""
    def apply(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = [(encode(x), encode(y)) for x, y in zip(left.to_pylist(), right.to_pylist())]
        cost, identities, length, _ = align_many([p[0] for p in pairs], [p[1] for p in pairs])
        return pa.StructArray.from_arrays([pa.array(cost), pa.array(identities), pa.array(length)], names=["cost", "identities", "length"])
    return F.arrow_udf(apply, "cost long, identities long, length long")(a, b)


def best_offset(a, b):
    """Shift of ``b`` against ``a`` with the most equal bases, and their number; the smallest shift on equal numbers."""
    if not len(a) or not len(b):
        return 0, 0
    matches = sum(np.correlate((a == base).astype(float), (b == base).astype(float), "full") for base in range(4))
    at = int(np.rint(matches).argmax())
    return at - (len(b) - 1), int(np.rint(matches[at]))


def gapless_alignment(a, b):
    """Struct ``offset, matches``: the best placement of ``b`` along ``a`` without gaps."""
    def apply(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [best_offset(encode(x), encode(y)) for x, y in zip(left.to_pylist(), right.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["offset", "matches"])
    return F.arrow_udf(apply, "offset long, matches long")(a, b)


SEPARATOR = -1.0


def split_genes(values):
    """Gene sequences of a signature in which every gene ends with the separator."""
    ends = np.flatnonzero(values == SEPARATOR)
    return [values[a:b].astype(np.uint8) for a, b in zip(np.concatenate(([0], ends[:-1] + 1)), ends)]


def gene_set_distance(a, b):
    """One minus the identities over the aligned length, summed over the genes.

    A gene missing on either side counts as one unlike position.
    """
    genes_a, genes_b = [split_genes(x) for x in a], [split_genes(x) for x in b]
    out = np.full((len(a), len(b)), np.nan)
    for i, mine in enumerate(genes_a):
        queries, targets, owner = [], [], []
        total = np.zeros(len(b))
        for j, theirs in enumerate(genes_b):
            for x, y in zip(mine, theirs):
                if len(x) and len(y):
                    queries.append(x), targets.append(y), owner.append(j)
                else:
                    total[j] += 1
        same = np.zeros(len(b))
        if owner:
            _, identities, length, _ = align_many(queries, targets)
            same += np.bincount(owner, weights=identities, minlength=len(b))
            total += np.bincount(owner, weights=length, minlength=len(b))
        with np.errstate(invalid="ignore"):
            out[i] = np.where(total > 0, 1.0 - same / total, np.nan)
    return out
