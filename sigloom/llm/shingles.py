"""Sets of hashed word shingles of whole texts, computed on the bytes of an Arrow column."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0xD1342543DE82EF95)
_powers = {}


def _mixed(x):
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed):
    """A random number for each byte, A-Z like a-z, and powers of an odd number with their inverses modulo 2**64."""
    if seed not in _powers:
        values = np.random.default_rng(seed + 1).integers(1, 2**63, 256, dtype=np.uint64)
        values[65:91] = values[97:123]
        _powers[seed] = [values, np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return _powers[seed]


def _grown(seed, n):
    table = _table(seed)
    if len(table[1]) < n:
        size = 1 << (n - 1).bit_length()
        for at, factor in ((1, int(_ODD)), (2, pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(size, np.uint64(factor))
            steps[0] = 1
            table[at] = np.cumprod(steps, dtype=np.uint64)
    return table


def _word_hashes(data, bounds, seed):
    """Hash and text number of each word; ``bounds`` are the offsets of the texts in ``data``."""
    space = _SPACE[data]
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[0], first[1:] = True, space[:-1]
    last[-1], last[:-1] = True, space[1:]
    inner = bounds[1:-1]
    first[inner[inner < len(data)]] = True
    last[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & first), np.flatnonzero(~space & last) + 1
    values, powers, inverse = _grown(seed, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:len(data)], out=total[1:])
    hashes = _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M)
    return hashes, np.searchsorted(bounds, starts, "right") - 1


def _chunked(texts):
    """``data, bounds`` of neighbouring texts, together at most ``CHUNK`` bytes or a single text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def shingle_sets(texts: pa.Array, seed: int = 0):
    """For each text its set of shingle hashes, sorted.  A text with one to four words has one, of all its words; without words none."""
    for data, bounds in _chunked(texts):
        n = len(bounds) - 1
        if not len(data):
            yield from (np.zeros(0, np.uint64) for _ in range(n))
            continue
        words, text = _word_hashes(data, bounds, seed)
        if len(words) >= WORDS:
            rolled = words[:len(words) - WORDS + 1].copy()
            for j in range(1, WORDS):
                rolled = rolled * _M + words[j:len(words) - WORDS + 1 + j]
            rolled = _mixed(rolled)
        edges = np.searchsorted(text, np.arange(n + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(rolled[a:b - WORDS + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = _mixed(np.array([whole]))[0] ^ w
                yield _mixed(np.array([whole]))
            else:
                yield np.zeros(0, np.uint64)


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
