"""Saved signatures: Parquet for everyday use, the binary signature file for exchange, and text.

The binary layout is a little-endian stream: a 4-byte magic, then one record of
``u16 unused, u16 kind, u16 type, u64 elements, u64 bytes, u64 label length, label, payload``; a record of the
collection kind holds that many further records instead of a payload.
"""

import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from sigloom.functions.text import number_text
from sigloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------
MAGIC = (ord("G") << 24) + (ord("S") << 16)
KINDS = (
    "UNKNOWN", "NONE", "SEQUENCE", "COUNTS", "FREQPROF", "MMZ", "KARLIN", "PRESABS", "HASHLIST", "SUFTREE", "MUXED",
    "GC", "GENOMELEN", "FILENAME", "KARLINL", "MULTINORM",
)
TYPES = ("NOSIG", "BYTE", "I32", "I64", "DBL", "SZT", "SUFTREEARRAY", "HASHTBL", "MUXED")
TYPE_FORMATS = {"BYTE": "b", "I32": "i", "I64": "q", "DBL": "d", "SZT": "Q"}
LEGACY_BYTES = 2
HEADER = "HHHQQQ"
# ----------------------------------------------------------------------------------------------

KIND_OF_BASIS = {"freq": "FREQPROF", "karl": "KARLIN", "karlL": "KARLINL", "exp": "MMZ", "mmzinf": "MMZ", "GC": "GC", "len": "GENOMELEN", "minhash": "HASHLIST"}
SCHEMA = "path string, pos long, name string, kind string, sig array<double>"


def save(sigs: DataFrame, path, mode="overwrite"):
    sigs.write.mode(mode).parquet(path)


def load(spark, path) -> DataFrame:
    return spark.read.parquet(path)


def _records(data, at, order):
    _, kind, kind_type, count, size, label_length = struct.unpack_from(order + HEADER, data, at)
    at += struct.calcsize(order + HEADER)
    if kind >= len(KINDS) or kind_type >= len(TYPES) or size < count or at + label_length > len(data):
        raise ValueError("not a signature record")
    name = data[at:at + label_length].decode("utf-8", "replace")
    at += label_length
    if KINDS[kind] == "MUXED":
        found = []
        for _ in range(count):
            part, at = _records(data, at, order)
            found += part
        return found, at
    if at + size > len(data):
        raise ValueError("truncated signature record")
    code = TYPE_FORMATS.get(TYPES[kind_type])
    values = [float(v) for v in struct.unpack_from(f"{order}{count}{code}", data, at)] if code else None
    return [(name, KINDS[kind], values)], at + size


def _legacy(data):
    """Older files without a magic: ``i32 type, u64 n, payload, i64 name length, name``, optionally after an i64 count."""
    def one(at):
        kind_type, n = struct.unpack_from("<iQ", data, at)
        at += 12
        code, width = ("b", 1) if kind_type == LEGACY_BYTES else ("d", 8)
        if n > len(data) // width:
            raise ValueError("not a legacy signature")
        values = [float(v) for v in struct.unpack_from(f"<{n}{code}", data, at)]
        at += n * width
        (length,) = struct.unpack_from("<q", data, at)
        return (data[at + 8:at + 8 + length].decode("utf-8", "replace"), "UNKNOWN", values), at + 8 + length

    try:
        first, end = one(0)
        if end == len(data):
            return [first]
    except (struct.error, ValueError):
        pass
    (count,) = struct.unpack_from("<q", data, 0)
    found, at = [], 8
    for _ in range(count):
        record, at = one(at)
        found.append(record)
    return found


def parse_binary(data):
    """``(name, kind, values)`` of every signature in one file's bytes, whatever its byte order or version."""
    if len(data) >= 4:
        for order in "<>":
            if struct.unpack_from(order + "i", data, 0)[0] == MAGIC:
                return _records(data, 4, order)[0]
    return _legacy(data)


SPLIT_BYTES = 32 << 20
_SPLITS = "path string, layout string, begin long, end long, first long"
_WINDOW = 1 << 20  # bytes read at a time while hopping
_BATCH_BYTES = 4 << 20


def _opened(path):
    """A file that can be read at any place, by the path that Spark gives it: local, or of any file system that Arrow knows."""
    local = re.sub("^file:/*", "/", path)
    if "://" not in local:
        return fs.LocalFileSystem().open_input_file(os.path.abspath(local))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inner)


def _windowed(file):
    """``read(at, n)``: small reads that go forward, served from a window of the file."""
    start, held = 0, b""

    def read(at, n):
        nonlocal start, held
        if at < start or at + n > start + len(held):
            start, held = at, file.read_at(max(n, _WINDOW), at)
        return held[at - start:at - start + n]
    return read


def _legacy_end(read, at, size):
    kind_type, n = struct.unpack("<iQ", read(at, 12))
    at += 12 + n * (1 if kind_type == LEGACY_BYTES else 8)
    if at + 8 > size:
        raise ValueError("truncated signature record")
    (length,) = struct.unpack("<q", read(at, 8))
    if length < 0:
        raise ValueError("not a legacy signature")
    return at + 8 + length


def record_places(read, size):
    """``layout, begin, end`` of every signature of a file, hopping from header to header; ``layout`` is the byte order or ``legacy``."""
    head = read(0, 4)
    layout = next((o for o in "<>" if len(head) == 4 and struct.unpack(o + "i", head)[0] == MAGIC), "legacy")
    at, left = 4, 1
    if layout == "legacy":
        try:
            at = 0 if _legacy_end(read, 0, size) == size else 8
        except (struct.error, ValueError):
            at = 8
        left = struct.unpack("<q", read(0, 8))[0] if at else 1
        if left < 0:
            raise ValueError("not a signature file")
    while left > 0:
        left -= 1
        if layout == "legacy":
            end = _legacy_end(read, at, size)
        else:
            _, kind, kind_type, count, payload, label = struct.unpack(layout + HEADER, read(at, struct.calcsize(layout + HEADER)))
            if kind >= len(KINDS) or kind_type >= len(TYPES) or payload < count:
                raise ValueError("not a signature record")
            end = at + struct.calcsize(layout + HEADER) + label
            if KINDS[kind] == "MUXED":
                at, left = end, left + count
                continue
            end += payload
        if end > size:
            raise ValueError("truncated signature record")
        yield layout, at, end
        at = end


def _splits(split_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _opened(path) as file:
                    rows, begin, n = [], None, 0
                    for layout, at, end in record_places(_windowed(file), file.size()):
                        begin, first = (at, n) if begin is None else (begin, first)
                        n += 1
                        if end - begin >= split_bytes:
                            rows.append((path, layout, begin, end, first))
                            begin = None
                    if begin is not None:
                        rows.append((path, layout, begin, end, first))
                names = ["path", "layout", "begin", "end", "first"]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
    return run


def _signature(data, at, layout):
    """``name, kind, values, end`` of the record at ``at``, without name for the header of a collection."""
    if layout == "legacy":
        kind_type, n = struct.unpack_from("<iQ", data, at)
        values = np.frombuffer(data, "<i1" if kind_type == LEGACY_BYTES else "<f8", n, at + 12)
        at += 12 + values.nbytes
        (length,) = struct.unpack_from("<q", data, at)
        return bytes(data[at + 8:at + 8 + length]).decode("utf-8", "replace"), "UNKNOWN", values, at + 8 + length
    _, kind, kind_type, count, size, label = struct.unpack_from(layout + HEADER, data, at)
    at += struct.calcsize(layout + HEADER)
    if KINDS[kind] == "MUXED":
        return None, None, None, at + label
    code = TYPE_FORMATS.get(TYPES[kind_type])
    name = bytes(data[at:at + label]).decode("utf-8", "replace")
    at += label
    values = np.frombuffer(data, np.dtype(code).newbyteorder(layout), count, at) if code else None
    return name, KINDS[kind], values, at + size


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for split in batch.to_pylist():
            with _opened(split["path"]) as file:
                data = memoryview(file.read_at(split["end"] - split["begin"], split["begin"]))
            at, pos, start, rows = 0, split["first"], 0, []
            while at < len(data):
                name, kind, values, at = _signature(data, at, split["layout"])
                if kind is not None:
                    rows.append((pos, name, kind, values))
                    pos += 1
                if rows and (at - start >= _BATCH_BYTES or at >= len(data)):
                    yield _arrow_rows(split["path"], rows)
                    start, rows = at, []


def _arrow_rows(path, rows):
    held = [r[3] for r in rows]
    offsets = np.cumsum([0, *(0 if v is None else len(v) for v in held)])
    values = np.concatenate([np.empty(0), *(v.astype("float64") for v in held if v is not None)])
    missing = pa.array([v is None for v in held])
    sig = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=missing)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), sig],
        names=["path", "pos", "name", "kind", "sig"])


def read_binary(spark, paths, split_bytes=SPLIT_BYTES) -> DataFrame:
    """One row per signature of ``.sig``/``.sdb`` files, ``pos`` counting them in their file; kinds without numbers have a NULL ``sig``.

    A task hops over the record headers of a file, reading windows and keeping none, to find where its ranges begin; ranges are dealt to tasks
    that read theirs into Arrow arrays.  So a collection of any size is many tasks and never one value.  A truncated or foreign file raises.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0").select("path")
    splits = cut_lineage(files.mapInArrow(_splits(split_bytes), _SPLITS))
    tasks = max(1, splits.count())
    return splits.repartition(min(tasks, 10_000), "path", "begin").mapInArrow(_parsed, SCHEMA)


def is_text(content, probe=200):
    """Whether the first bytes of a binary column are printable text."""
    head = F.substring(content, 1, probe)
    return F.coalesce(F.try_validate_utf8(head).rlike(r"^[\x09\x0A\x0D\x20-\x7E]*$"), F.lit(False))


def binary_record(name, kind, values):
    """Bytes of one signature record (without the magic)."""
    label = (name or "").encode("utf-8")
    payload = struct.pack(f"<{len(values)}d", *values)
    return struct.pack("<" + HEADER, 0, KINDS.index(kind), TYPES.index("DBL"), len(values), len(payload), len(label)) + label + payload


def binary_files(sigs: DataFrame, kind) -> DataFrame:
    """``id, content``: a readable single-signature file per row."""
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [struct.pack("<i", MAGIC) + binary_record(n, kind, list(s)) for n, s in zip(frame["name"], frame["sig"])]
            yield pd.DataFrame({"name": frame["name"], "content": content})
    named = sigs.select(F.col("name" if "name" in sigs.columns else "id").cast("string").alias("name"), "sig")
    return named.mapInPandas(build, "name string, content binary")


def text_lines(sigs: DataFrame, kind, prefix="") -> DataFrame:
    """``line``: ``[prefix.]name.Kind,v0,v1,…`` per signature."""
    name = F.col("name" if "name" in sigs.columns else "id").cast("string")
    head = F.concat(F.lit(prefix + "." if prefix else ""), name, F.lit("." + kind))
    values = F.transform("sig", lambda x: number_text(x))
    return sigs.select(F.concat_ws(",", head, F.array_join(values, ",")).alias("line"))


SAVE_MODES = ("continue", "stop", "average", "text")


def save_signatures(sigs: DataFrame, path, mode="continue", kind="KARLIN") -> bool:
    """Save and say whether the run goes on: ``continue`` and ``stop`` keep a table, ``average`` its mean, ``text`` lines."""
    from sigloom.operators.profiles import average_signature

    if mode not in SAVE_MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {SAVE_MODES}")
    if mode == "average":
        save(average_signature(sigs), path)
    elif mode == "text":
        text_lines(sigs, kind).write.mode("overwrite").text(path)
    else:
        save(sigs, path)
    return mode == "continue"
