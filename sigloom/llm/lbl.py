"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation.

* **Counts.** Every token of every training text is counted: per task, then summed by word.  The counts give the base score and the vocabulary.
* **Outputs.** The most frequent tokens are outputs of the network (``Shape.outputs``).  All further words belong to classes by the size of their count,
  which are outputs too; the rarest class also holds every word never seen.  A word of a class has the class's probability times its own share,
  so the probabilities of all words, with one event for all unseen ones, add up to one.
* **Network.** Two context words; the predicted vector is the sum of their vectors, each weighted per dimension and place; an output's score is its dot
  product with the output's vector, plus a bias.  Each task trains on its own texts by noise-contrastive estimation, and the tasks' parameters are
  averaged, weighted by tokens.  The rounds take disjoint slices of the training texts: together they read each text once.
* **Scores.** Batched matrix products give the score of every output behind every context word, and the logarithm of the sum over all outputs
  for every pair of context words.  Both tables have the size of the network's shape, not of the corpus, so a token's normalised
  log-probability is four look-ups.
* **Rare words.** Words with a share of at least one in ``Shape.lookup`` of all tokens are at most that many and travel to the tasks; the others are joined
  by word, where no key is hot.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import LOWER, UPPER, Written, pick

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The end of a text as a token: no word holds a line break.
END = b"\n"
#: Distinct words that a task counts before it hands them on.
_OPEN_COUNTS = 400_000


@dataclass(frozen=True)
class Shape:
    """``outputs`` words with vectors of their own, ``dim`` numbers each; ``noise`` samples per batch of ``batch`` tokens; ``slices`` are
    the shares of training texts per round."""
    outputs: int = 1_000
    dim: int = 16
    noise: int = 64
    batch: int = 2_048
    rate: float = 0.1
    slices: tuple[float, ...] = (0.15, 0.35, 0.5)
    lookup: int = 1 << 20
    folds: int = 7
    held_out: int = 2


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and its end."""
    words = text.encode().translate(_LOWER).split() if text else []
    words.append(END)
    return words


def fold_of(doc_id: int, folds=7) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def _rows(docs: DataFrame, shape: Shape, id_col, text_col) -> DataFrame:
    """``doc_id, held_out, at, text``; ``at`` (0 to 1) deals the training texts over the rounds.  A null id is never held out."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return rows.select("doc_id", F.coalesce(crc % shape.folds == shape.held_out, F.lit(False)).alias("held_out"), "text")


# ---------------------------------------------------------------------------------------------------------------- counts
def counted(rows: DataFrame, written: Written) -> DataFrame:
    """``word, n`` over all tokens of ``rows.text``."""
    def flushed(counts):
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def partial(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
                if len(counts) > _OPEN_COUNTS:
                    yield flushed(counts)
                    counts = Counter()
        if counts:
            yield flushed(counts)

    return written.table(rows.select("text").mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """``words`` travel to the tasks, with their outputs (``codes``) and ``counts``; all other words are in the last output.

    ``class_total`` and ``class_words`` are the tokens and distinct words of each output; the first ``own`` outputs are single words.
    """
    words: list[bytes]
    codes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    own: int
    class_total: np.ndarray
    class_words: np.ndarray

    @property
    def tail(self):
        return len(self.class_total) - 1

    def base(self, count):
        """log10 probability of a token with that count by the base rule."""
        return np.log10((np.asarray(count) + 1.0) / (self.total + self.distinct + 1.0))

    def tail_size(self):
        """What shares of the last class are counted against: its tokens, and one for each of its words and for the unseen event."""
        return float(self.class_total[-1] + self.class_words[-1] + 1)

    def within(self, code, count):
        """log10 share of a word in its output's class.  In the last class the unseen words are one event, counted as often as there are words (Witten-Bell)."""
        code, count = np.asarray(code), np.asarray(count, "f8")
        last = np.where(count > 0, count, self.class_words[-1] + 1.0) / self.tail_size()
        return np.log10(np.where(code < self.own, 1.0, np.where(code < self.tail, count / np.maximum(self.class_total[code], 1), last)))


def _least(total, shape):
    """The smallest count of a word that travels.  A word seen once never does, so that the last output stands for rare and unseen words in every corpus."""
    return max(2, -(-total // shape.lookup))


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = totals["total"] or 0, totals["distinct"]
    rows = [(bytes(r["word"]), r["n"]) for r in counts.filter(F.col("n") >= _least(total, shape)).collect()]  # at most shape.lookup of them
    rows.sort(key=lambda r: (-r[1], r[0]))
    n = np.array([n for _, n in rows], np.int64)
    own = min(shape.outputs, len(rows))
    # further words: one class for each number of binary digits of the count
    digits = np.floor(np.log2(np.maximum(n[own:], 1))).astype(np.int64)
    step = np.r_[0, np.cumsum(digits[1:] != digits[:-1])] if len(digits) else digits
    codes = np.r_[np.arange(own), own + step].astype(np.uint16)
    classes = own + (int(step[-1]) + 1 if len(step) else 0)
    class_total, class_words = np.bincount(codes, n, classes).astype(np.int64), np.bincount(codes, minlength=classes)
    return Vocabulary([w for w, _ in rows], codes, n, total, distinct, own, np.append(class_total, total - n.sum()), np.append(class_words, distinct - len(rows)))


# ---------------------------------------------------------------------------------------------------------------- network
def initial(vocab: Vocabulary, shape: Shape, seed=1) -> dict[str, np.ndarray]:
    """``r``: vectors of the contexts (the last one stands before a text), ``q``: of the outputs, ``c``: weights per place, ``b``: biases."""
    rng = np.random.default_rng(seed)
    outputs = len(vocab.class_total)
    share = (vocab.class_total + 1.0) / (vocab.class_total.sum() + outputs)
    return {"r": rng.normal(0, 0.1, (outputs + 1, shape.dim)).astype("f4"), "q": rng.normal(0, 0.1, (outputs, shape.dim)).astype("f4"),
            "c": np.ones((2, shape.dim), "f4"), "b": np.log(share).astype("f4")}


def _add(target, codes, rows):
    """Add ``rows`` to the rows ``codes`` of ``target``, repeated ones included."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    target[codes[start]] += np.add.reduceat(rows[order], start, axis=0)


def _sigmoid(x):
    return np.float32(0.5) * (np.float32(1.0) + np.tanh(np.float32(0.5) * x))


class Trainer:
    """Noise-contrastive estimation on triples (word before last, last word, word) of output codes, in batches, with Adagrad steps."""

    def __init__(self, parameters, class_total, shape: Shape, seed):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.g = {k: np.full(v.shape, 1e-2, "f4") for k, v in parameters.items()}
        self.shape, self.rng, self.seen = shape, np.random.default_rng(seed), 0
        share = (class_total + 1.0) / (class_total.sum() + len(class_total))
        self.ends = np.cumsum(share)
        self.shift = np.log(shape.noise * share).astype("f4")  # log of k times the noise probability

    def batch(self, before, last, word):
        p, n = self.p, len(word)
        noise = np.minimum(np.searchsorted(self.ends, self.rng.random(self.shape.noise)), len(self.ends) - 1).astype(word.dtype)
        contexts = np.concatenate([last, before])
        r, qw, qn = p["r"][contexts], p["q"][word], p["q"][noise]
        r1, r2, (c1, c2) = r[:n], r[n:], p["c"]
        h = r1 * c1
        h += r2 * c2
        bias = p["b"] - self.shift
        true = _sigmoid(-np.einsum("ij,ij->i", h, qw) - bias[word])  # 1 - P(from the data)
        false = -_sigmoid(h @ qn.T + bias[noise])
        dh = false @ qn
        dh += true[:, None] * qw
        scale = np.float32(1.0 / np.sqrt(n))
        dc = np.stack([np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2)])
        dq = np.zeros_like(p["q"])
        db = np.bincount(word, true, len(bias)) + np.bincount(noise, false.sum(axis=0), len(bias))
        _add(dq, word, true[:, None] * h)
        _add(dq, noise, false.T @ h)
        dr = np.zeros_like(p["r"])
        _add(dr, last, dh * c1)
        _add(dr, before, dh * c2)
        for name, gradient in (("q", dq), ("b", db.astype("f4")), ("r", dr), ("c", dc)):
            gradient *= scale
            self.g[name] += gradient * gradient
            p[name] += np.float32(self.shape.rate) * gradient / np.sqrt(self.g[name])
        self.seen += n

    def texts(self, flat, ends, start_code):
        """One pass over texts that lie one behind the other; contexts do not reach over a text's start."""
        before, last = _contexts(flat, ends, start_code)
        order = self.rng.permutation(len(flat))
        for at in range(0, len(flat), self.shape.batch):
            some = order[at:at + self.shape.batch]
            self.batch(before[some], last[some], flat[some])


def _contexts(flat, ends, start_code):
    """For each token the word before last and the last word of its text."""
    start = np.r_[0, ends[:-1]]
    last = np.r_[start_code, flat[:-1]].astype(flat.dtype)
    last[start] = start_code
    before = np.r_[start_code, last[:-1]].astype(flat.dtype)
    before[start] = start_code
    return before, last


def _joined(batch):
    """Codes of all texts of a batch in one array, and where each text ends."""
    column = batch.column("codes")
    lengths = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16), np.cumsum(lengths)


def _averaged(parameters: DataFrame) -> DataFrame:
    """Averages of ``name, row, weight, total, values`` by row, weighted; a row comes once per task, so the sums are dealt by row."""
    def run(batches):
        sums = {}
        for batch in batches:
            for name, row, weight, values in zip(*(batch.column(c).to_pylist() for c in ("name", "row", "weight")), batch.column("values").to_pylist()):
                held = sums.get((name, row))
                values = np.frombuffer(values, "f4") * weight
                sums[name, row] = (weight, values) if held is None else (held[0] + weight, held[1] + values)
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()),
                pa.array([(v / w).astype("f4").tobytes() for w, v in sums.values()], pa.binary())], names=["name", "row", "weight", "values"])

    schema = "name string, row int, weight double, values binary"
    some = parameters.withColumn("salt", F.spark_partition_id() % 16).repartition("name", "row", "salt").drop("salt").mapInArrow(run, schema)
    return some.repartition("name", "row").mapInArrow(run, schema)


def trained(coded: DataFrame, vocab: Vocabulary, shape: Shape) -> dict[str, np.ndarray]:
    """Parameters after one pass over ``coded`` (``at, codes``) in rounds of disjoint slices.  The driver holds one set of parameters."""
    spark = coded.sparkSession
    parameters, start = initial(vocab, shape), 0.0
    for number, share in enumerate(shape.slices):
        shared = spark.sparkContext.broadcast((parameters, vocab.class_total))

        def run(batches, shared=shared, number=number):
            now, class_total = shared.value
            trainer = Trainer(now, class_total, shape, number)
            for batch in batches:
                flat, ends = _joined(batch)
                if len(flat):
                    trainer.texts(flat, ends, len(class_total))
            if trainer.seen:
                rows = [(name, i, part.tobytes()) for name, values in trainer.p.items() for i, part in enumerate(np.array_split(values, max(1, len(values) // 128)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(trainer.seen)] * len(rows), pa.float64()),
                    pa.array([r[2] for r in rows], pa.binary())], names=["name", "row", "weight", "values"])

        last = number + 1 == len(shape.slices)
        some = coded.filter((F.col("at") >= start) & (F.lit(last) | (F.col("at") < start + share)))
        start += share
        rows = _averaged(some.select("codes").mapInArrow(run, "name string, row int, weight double, values binary")).collect()
        shared.unpersist()
        for name, values in parameters.items() if rows else ():
            parts = [np.frombuffer(r["values"], "f4") for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["row"])]
            parameters[name] = np.concatenate(parts).reshape(values.shape)
    return parameters


# ---------------------------------------------------------------------------------------------------------------- normalised log-probabilities
@dataclass
class Model:
    """``first[last, v]`` and ``second[before, v]`` are scores of the outputs (the bias is in ``first``), ``norm[before, last]`` the log of their sum."""
    vocab: Vocabulary
    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray

    def log10(self, before, last, word):
        """log10 probability of outputs behind two context codes."""
        return (self.first[last, word] + self.second[before, word] - self.norm[before, last]) / np.log(10.0)


def normalised(spark, parameters, vocab: Vocabulary) -> Model:
    """The tables of ``Model``; the pairs of context words are dealt over tasks, each a product of all outputs for a row of pairs."""
    contexts = len(parameters["r"])
    shared = spark.sparkContext.broadcast(parameters)

    def tables(p):
        return (p["r"] * p["c"][0]) @ p["q"].T + p["b"], (p["r"] * p["c"][1]) @ p["q"].T

    def run(batches):
        first, second = tables(shared.value)
        top_first = first.max(axis=1)
        small = np.exp(first - top_first[:, None]).astype("f4")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = batch.column("id")[at:at + 64]
                some = second[ids.to_numpy()]
                top = some.max(axis=1)[:, None]
                # for each pair of contexts, the sum over all outputs of exp(first + second)
                out = np.log(np.maximum(np.exp(some - top) @ small.T, 1e-37)) + top + top_first
                yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in out.astype("f4")], pa.binary())], names=["id", "norm"])

    got = spark.range(contexts).mapInArrow(run, "id long, norm binary").collect()  # contexts squared, four bytes each
    norm = np.stack([np.frombuffer(r["norm"], "f4") for r in sorted(got, key=lambda r: r["id"])])
    first, second = tables(parameters)
    return Model(vocab, first, second, norm)


# ---------------------------------------------------------------------------------------------------------------- scores
_CODED = "doc_id long, held_out boolean, codes binary, n_tokens long, n_known long, base double, inner double, rare array<binary>, times array<int>"


def coded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every text as output codes, with what the words that travel add to its scores, and its other words with their numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(vocab))

    def run(batches):
        vocab = Vocabulary(**shared.value)
        place, other = {w: i for i, w in enumerate(vocab.words)}, len(vocab.words)
        # by place in the table; the last place stands for all other words
        code = np.append(vocab.codes, np.uint16(vocab.tail))
        base, inner = np.append(vocab.base(vocab.counts), 0.0), np.append(vocab.within(vocab.codes, vocab.counts), 0.0)
        get = place.get
        for batch in batches:
            codes, sums, rare, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                at = np.fromiter((get(w, other) for w in words), np.int64, len(words))
                codes.append(code[at].tobytes())
                unknown = np.flatnonzero(at == other)
                found = Counter(words[i] for i in unknown.tolist())
                rare.append(list(found))
                times.append(list(found.values()))
                sums.append((len(words), len(words) - len(unknown), base[at].sum(), inner[at].sum()))
            n_tokens, n_known, b, i = zip(*sums) if sums else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(codes, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                pa.array(b, pa.float64()), pa.array(i, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "codes", "n_tokens", "n_known", "base", "inner", "rare", "times"])

    return rows.mapInArrow(run, _CODED)


def network_scores(codes: DataFrame, model: Model) -> DataFrame:
    """``row, net``: log10 probability of each text's output codes."""
    shared = codes.sparkSession.sparkContext.broadcast((model.first, model.second, model.norm))

    def run(batches):
        tables = Model(None, *shared.value)
        start_code = tables.first.shape[1]
        for batch in batches:
            flat, ends = _joined(batch)
            before, last = _contexts(flat, ends, start_code)
            sums = np.add.reduceat(tables.log10(before, last, flat).astype(np.float64), np.r_[0, ends[:-1]]) if len(flat) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums, pa.float64())], names=["row", "net"])

    return codes.select("row", "codes").mapInArrow(run, "row long, net double")


def fitted(docs: DataFrame, shape: Shape = Shape(), id_col="doc_id", text_col="text") -> tuple[Model, DataFrame, DataFrame]:
    """The model learnt from the training texts of ``docs``, the table of counts, and all texts as codes."""
    written = Written(docs.sparkSession)
    rows = _rows(docs, shape, id_col, text_col)
    counts = counted(rows.filter("not held_out"), written)
    vocab = vocabulary(counts, shape)
    codes = written.table(coded(rows, vocab).withColumn("row", F.monotonically_increasing_id()))
    dealt = (F.xxhash64("row") % 1_000_003) / 1_000_003.0
    at = F.when(dealt < 0, dealt + 1.0).otherwise(dealt)
    parameters = trained(codes.filter("not held_out").select(at.alias("at"), "codes"), vocab, shape)
    return normalised(docs.sparkSession, parameters, vocab), counts, codes


def score(docs: DataFrame, shape: Shape = Shape(), id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Training texts are those whose ``crc32(doc_id as text) % folds`` is not ``held_out``; a null id is one of them.  A null or empty text is an end alone.
    Rows that repeat count each time.  Without training texts every token is unseen, and both scores are those of one single event: 0.
    """
    model, counts, codes = fitted(docs, shape, id_col, text_col)
    vocab = model.vocab
    words = codes.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    known = words.join(counts.filter(F.col("n") < _least(vocab.total, shape)), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = known.groupBy("row").agg(
        F.sum("times").alias("rare_tokens"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("base_logs"),
        F.sum(F.col("times") * F.log10(F.when(F.col("n") > 0, F.col("n")).otherwise(int(vocab.class_words[-1]) + 1))).alias("logs"))
    base_part = float(np.log10(vocab.total + vocab.distinct + 1.0))
    inner_part = float(np.log10(vocab.tail_size()))
    net = network_scores(codes, model)
    out = codes.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner").join(net, "row").join(rare, "row", "left")
    logs, base_logs, many = F.coalesce("logs", F.lit(0.0)), F.coalesce("base_logs", F.lit(0.0)), F.coalesce("rare_tokens", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + base_logs - many * base_part).alias("base_score"), (F.col("net") + F.col("inner") + logs - many * inner_part).alias("score"))
