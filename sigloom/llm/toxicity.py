"""Toxicity by a weighted lexicon, found with Aho-Corasick in folded text and normalised by length.

Terms are whole words (``" word "``) and word beginnings (``" wor"``), with log-odds weights learned from labelled rows; exception
phrases (``" trash can "``) cancel the hits they cover.  A logistic curve turns hits per length into a score.
"""

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written, pick

#: Letters of other scripts that look like Latin ones, and characters written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b",
              "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof")

_GLYPHS = str.maketrans({**HOMOGLYPHS, **{chr(0xFF21 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
                         "​": None, "‌": None, "‍": None, "­": None})
# stand-ins count when a letter follows their run; each run is matched once
_STANDINS, _LETTER = re.compile(r"[013457@$]+"), re.compile(r"[^\W\d_]")
_LETTERS_FOR = str.maketrans(WRITTEN_FOR)
_OTHER = re.compile(r"[\W_]+")
PREFIXES = range(3, 9)


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, stand-ins inside words as letters, words parted by one space, a space at both ends."""
    text = text.lower().translate(_GLYPHS)
    text = _STANDINS.sub(lambda m: m[0].translate(_LETTERS_FOR) if _LETTER.match(m.string, m.end()) else m[0], text)
    return f" {_OTHER.sub(' ', text).strip()} "


def terms_of(text: str) -> set[str]:
    """Every term a text offers to the lexicon."""
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in PREFIXES if k < len(word))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -3.0
    slope: float = 2.0
    smoothing: float = 10.0
    length_power: float = 0.5

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            if folded.strip():
                found.add_word(folded, (len(folded), None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, folded: str, automaton) -> dict[int, tuple[float, int]]:
        """Start of a hit word -> (largest weight, length of that term); hits inside an exception phrase are left out."""
        best, free = {}, []
        for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
            start = end - length + 1
            if weight is None:
                free.append((start, end))
            elif start not in best or best[start][0] < weight:
                best[start] = (weight, length)
        if not free:
            return best
        out, reach, at = {}, -1, 0
        free.sort()
        for start in sorted(best):
            while at < len(free) and free[at][0] <= start:
                reach, at = max(reach, free[at][1]), at + 1
            if start >= reach:
                out[start] = best[start]
        return out

    def density(self, text: str, automaton) -> float:
        """Weight over a power of the length, on a log scale: a few hits in a long text are thinner than in a short one, but not nothing.

        ``smoothing`` words are added, so one hit in a short text does not count in full; ``n`` hits of one term weigh ``1 + ln n`` times, so
        a word that is merely repeated does not outweigh several terms.
        """
        folded = fold(text)
        times = Counter((folded[start:start + length], w) for start, (w, length) in self.hits(folded, automaton).items())
        total = sum(w * (1.0 + np.log(n)) for (_, w), n in times.items())
        words = max(folded.count(" ") - 1, 0) + self.smoothing
        return float(np.log1p(10.0 * total / words ** self.length_power))

    def probability(self, density):
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * np.asarray(density, "f8"))))


@dataclass(frozen=True)
class Training:
    """``rows_per_class`` bounds the labelled rows that are read for learning; they are those with the smallest hash of their id.

    A term must reach ``min_weight`` and ``min_share`` of the largest weight: among many thousand words some lean to one side by chance.
    """
    rows_per_class: int = 12_000
    min_texts: int = 4
    min_weight: float = 2.0
    min_z: float = 3.0
    min_share: float = 0.5
    folds: int = 5
    held_out: int = 0
    calibration: int = 4


def _counted(rows: DataFrame, of, schema="term string, n long") -> DataFrame:
    """Sums of the counters that ``of`` makes of each batch of texts."""
    def partial(batches):
        for batch in batches:
            counts = of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), "string"), pa.array(list(counts.values()), "int64")], names=["term", "n"])
    return rows.mapInArrow(partial, schema).groupBy("term").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, labels: DataFrame, how: Training, written: Written) -> tuple[DataFrame, dict[int, float]]:
    """The training rows ``text, label, fold``, and for each label how many labelled rows one of them stands for.

    The ids and labels of the sample are at most ``2 * rows_per_class`` rows, so they may be broadcast to all documents.
    """
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % how.folds
    usable = labels.groupBy("doc_id").agg(F.max("label").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.withColumn("fold", fold_of).filter(F.col("fold") != how.held_out)
    chosen = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.rows_per_class) for k in (0, 1)]
    chosen = written.table(chosen[0].unionAll(chosen[1]))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    read = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int"), F.col("fold").cast("int"))
    return written.table(rows.dropDuplicates(["text"])), {k: totals[k] / read[k] for k in read}


def learn(docs: DataFrame, labels: DataFrame, how: Training = Training(), exceptions=EXCEPTIONS) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, label).  Without rows of both labels it stays empty.

    Weights come from all folds but the held-out and the calibration fold; the curve is fitted on the latter.  What reaches the
    driver are counts of terms and phrases that stand in several texts of the bounded sample.
    """
    written = Written(docs.sparkSession)
    rows, stands_for = sample(docs, labels, how, written)
    if set(stands_for) != {0, 1}:
        return Lexicon(exceptions=tuple(exceptions))
    fit = rows.filter(F.col("fold") != how.calibration)

    def texts(batch):
        return batch.column("text").to_pylist()

    def offered(batch):
        return Counter(t for text in texts(batch) for t in terms_of(text))

    toxic = _counted(fit.filter("label = 1").select("text"), offered).filter(F.col("n") >= how.min_texts)
    toxic = {r["term"]: r["n"] for r in toxic.collect()}

    def known(batch):
        return Counter(t for text in texts(batch) for t in terms_of(text) & toxic.keys())

    clean = {r["term"]: r["n"] for r in _counted(fit.filter("label = 0").select("text"), known).collect()}
    sizes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    found = {}
    for term, t in toxic.items():
        c = clean.get(term, 0)
        odds = np.log((t + 0.5) / (sizes.get(1, 0) + 1)) - np.log((c + 0.5) / (sizes.get(0, 0) + 1))
        if odds >= how.min_weight and odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= how.min_z:
            found[term] = (t, float(odds))
    least = how.min_share * max((w for _, w in found.values()), default=0.0)
    found = _specific({term: v for term, v in found.items() if v[1] >= least})
    kept = sorted(found, key=lambda term: (-found[term][0] * found[term][1], term))
    lexicon = Lexicon({term: found[term][1] for term in kept}, tuple(exceptions))
    lexicon.exceptions += _learned_exceptions(fit, lexicon)
    return _calibrated(lexicon, rows.filter(F.col("fold") == how.calibration), stands_for)


def _specific(found: dict[str, tuple[int, float]], share=0.8) -> dict[str, tuple[int, float]]:
    """Without the word beginnings that one longer term stands for: ``" los"`` next to ``" loser "``."""
    largest: dict[str, int] = {}
    for term, (n, _) in found.items():
        for k in PREFIXES:
            if k + 1 < len(term):
                largest[term[:k + 1]] = max(largest.get(term[:k + 1], 0), n)
    return {term: v for term, v in found.items() if largest.get(term, 0) < share * v[0]}


def _learned_exceptions(fit: DataFrame, lexicon: Lexicon, min_texts=3) -> tuple[str, ...]:
    """Pairs of a hit word and its neighbour that clean texts use and toxic ones hardly do."""
    def phrases(batch):
        automaton, out = lexicon.automaton(), Counter()
        for text in batch.column("text").to_pylist():
            folded, seen = fold(text), set()
            for start in lexicon.hits(folded, automaton):
                end = folded.find(" ", start + 1)
                before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
                seen.update(folded[a:b].strip() for a, b in ((before, end), (start, after)) if a >= 0 and b > end - 1 and b > 0)
            out.update(p for p in seen if p.count(" ") == 1)
        return out

    clean = {r["term"]: r["n"] for r in _counted(fit.filter("label = 0").select("text"), phrases).filter(F.col("n") >= min_texts).collect()}
    if not clean:
        return ()

    def met(batch):
        return Counter({p: n for p, n in phrases(batch).items() if p in clean})

    toxic = {r["term"]: r["n"] for r in _counted(fit.filter("label = 1").select("text"), met).collect()}
    return tuple(sorted(p for p, n in clean.items() if n > toxic.get(p, 0)))


def _calibrated(lexicon: Lexicon, rows: DataFrame, stands_for: dict[int, float]) -> Lexicon:
    """Fit the logistic curve by Newton steps on the calibration rows, each weighted by how many labelled rows it stands for."""
    def measure(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lexicon.density(t, automaton) for t in batch.column("text").to_pylist()], "float64"), batch.column("label")], names=["x", "label"])

    got = sorted((r["x"], r["label"]) for r in rows.select("text", "label").mapInArrow(measure, "x double, label int").collect())
    x, y = np.array([x for x, _ in got], "f8"), np.array([label for _, label in got], "f8")
    if not (y == 1).any() or not (y == 0).any():
        return lexicon
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    design, beta, ridge = np.c_[np.ones_like(x), x], np.array([lexicon.intercept, lexicon.slope]), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    lexicon.intercept, lexicon.slope = float(beta[0]), float(max(beta[1], 0.0))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, folds=5, held_out=0, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text counts.  A null or empty text has no hits and gets the score of a text without hits; a null id is never held out.
    Rows that repeat come out as often; an empty table gives none; further columns, whatever their names, are left out.
    """
    def scored(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            density = [lexicon.density(t, automaton) if t else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lexicon.probability(density), "float64")],
                                             names=["doc_id", "held_out", "score"])

    narrow = pick(docs, doc_id=id_col, text=text_col)
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = narrow.select(F.col("doc_id").cast("long"), F.coalesce(fold_of == held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_fold(doc_id: int, folds=5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def score_by_labels(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """Learn from the labels outside the held-out fold, then ``score`` every document.

    Several labels of one id count as the largest, labels without an id or document and repeated texts of the sample not at all; without labels of
    both kinds the lexicon is empty and all scores are equal.
    """
    narrow = pick(docs, doc_id=id_col, text=text_col)
    lexicon = learn(narrow, pick(labels, doc_id=id_col, label=label_col), how)
    return score(narrow, lexicon, how.folds, how.held_out)
