"""SentencePiece models on the tokenizers library: the model file is parsed, its parts are rebuilt, and both must agree.

``encode`` and ``decode`` work on whole texts in Arrow batches.  Special tokens in a text are ordinary text.
"""

import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import pick

MARK = "▁"
#: Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that go through the library at once; a longer text goes alone.
CHUNK = 1 << 19


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    space_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)


def _fields(data: bytes):
    """The fields of a protobuf message as ``(number, value)``: an int, or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a model file")
            size = number()
        yield tag >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL, **dict(_fields(value))}
            model.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model.model_type, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            model.space_as_suffix = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    if model.model_type not in (UNIGRAM, BPE) or not model.pieces or model.space_as_suffix or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with a leading space mark can be rebuilt")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece from two others, best piece first: the merge table that piece scores stand for."""
    scores = {p: (-s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, rank in scores.items():
        found += [(rank, at, piece[:at], piece[at:]) for at in range(1, len(piece)) if piece[:at] in scores and piece[at:] in scores]
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model, bytes_first=False):
    """The tokenizer of ``model``: normaliser, space mark, unigram scores or merges, byte fallback, and the decoder that undoes them.

    The decoder turns marks into spaces before it joins byte pieces, as bytes that spell a mark are no space.  ``bytes_first`` joins first, which is
    cheaper and the same for ids without the mark's first byte.  Texts are not cut before merging: the library's merge queue takes them whole.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        unknown = None if model.unknown is None else model.pieces[model.unknown][0]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    spaces, joined = [decoders.Replace(MARK, " ")], [decoders.ByteFallback(), decoders.Fuse()]
    undo = (joined + spaces if bytes_first else spaces + joined) + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


class Codec:
    """Both libraries on one model file."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = parse_model(data)
        self.exact, self.quick, self.own = build(model), build(model, bytes_first=True), sentencepiece.SentencePieceProcessor(model_proto=data)
        first = f"<0x{MARK.encode()[0]:02X}>"
        self.mark_byte = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == first), -1)
        self.space_byte = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == "<0x20>"), -1) if model.dummy_prefix else -1
        self.mark = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL and p == MARK), -1)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.quick.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        # a space that is written as a byte is no mark: a mark before it takes its place as the one that is stripped
        ids = [[self.mark, *x] if x and x[0] == self.space_byte and self.mark >= 0 else x for x in ids]
        odd = [i for i, x in enumerate(ids) if self.mark_byte in x]
        out = self.quick.decode_batch(ids, skip_special_tokens=False)
        for i, text in zip(odd, self.exact.decode_batch([ids[i] for i in odd], skip_special_tokens=False)):
            out[i] = text
        return out


@lru_cache(maxsize=4)
def _loaded(path: str, threads: int) -> Codec:
    """One codec per worker process, read where the executor can: the given path, or the copy that Spark shipped."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    data = open(path, "rb").read() if os.path.exists(path) else open(SparkFiles.get(os.path.basename(path)), "rb").read()
    return Codec(data)


def _chunks(column, limit=CHUNK):
    """Neighbouring texts whose lengths add up to ``limit`` at most; only one part of the column is held as Python strings."""
    part, size = [], 0
    for value in column:
        text = value.as_py()
        if part and size + len(text or "") > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def ship_model(spark, path: str) -> str:
    """Make the model file readable for all executors; its content stays outside the repository."""
    spark.sparkContext.addFile(path)
    return path


def encode(texts: DataFrame, path: str, id_col="doc_id", text_col="text", threads=2, verify_every=1) -> DataFrame:
    """One row per row: ``doc_id, ids, round_trip, parity``.

    ``round_trip`` tells that the decoder gives the very text back.  ``parity`` tells that the model's own library gives the same ids; it is asked for one row in
    ``verify_every`` (1: all, 0: none), chosen by the hash of the text, and null for the others.  A null text has nulls in all
    three; an empty one has no ids.  Rows that repeat come out as often; further columns, whatever their names, are left out.  ``threads`` encode the texts of a batch side by side.
    """
    def run(batches):
        codec = _loaded(path, threads)
        for batch in batches:
            at = 0
            for part in _chunks(batch.column("text")):
                texts = list(dict.fromkeys(t for t in part if t is not None))  # a text that repeats in the batch is coded once
                coded = codec.encode(texts)
                whole = [back == t for t, back in zip(texts, codec.decode(coded))]
                asked = [i for i, t in enumerate(texts) if verify_every == 1 or verify_every and zlib.crc32(t.encode()) % verify_every == 0]
                same = [None] * len(texts)
                for i, other in zip(asked, codec.own.encode([texts[i] for i in asked], num_threads=threads)):
                    same[i] = coded[i] == other
                place = {t: i for i, t in enumerate(texts)}
                at_of = [None if t is None else place[t] for t in part]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(part)), *[
                        pa.array([None if i is None else values[i] for i in at_of], kind) for values, kind in ((coded, pa.list_(pa.int32())), (whole, pa.bool_()), (same, pa.bool_()))]],
                    names=["doc_id", "ids", "round_trip", "parity"])
                at += len(part)

    ship_model(texts.sparkSession, path)
    rows = pick(texts, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean, parity boolean")


def decode(rows: DataFrame, path: str, id_col="doc_id", ids_col="ids", threads=2) -> DataFrame:
    """``doc_id, text`` of ids, one row per row, repeated ones too; null ids give a null text, no ids an empty one.  Further columns are left out."""
    def run(batches):
        codec = _loaded(path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                lists = some.column("ids").to_pylist()
                texts = codec.decode([i or [] for i in lists])
                texts = pa.array([None if i is None else t for i, t in zip(lists, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), texts], names=["doc_id", "text"])

    ship_model(rows.sparkSession, path)
    return pick(rows, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
