"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes becomes one small table of signed sums.  It counts from the moment its commit record exists; the record is created
with a file that must not exist before, so a batch that is sent twice, or by two writers, counts once.  Totals are the sum of all
committed deltas, which a checkpoint folds into one table from time to time.
"""

import base64
import json
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import pick

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


@lru_cache(maxsize=4)
def _encoding(file: str, pattern: str):
    import os

    import tiktoken

    path = file if os.path.exists(file) else SparkFiles.get(os.path.basename(file))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, file: str, pattern: str, text_col="text", out_col="tokens") -> DataFrame:
    """``rows`` with the number of tokens of a text under a vocabulary of ranks, and without the text.  A null text has none.

    Special tokens are ordinary text.  Whole texts are encoded, batch by batch, on the executors.
    """
    rows.sparkSession.sparkContext.addFile(file)
    kept = [c for c in rows.columns if c != text_col]
    schema = ", ".join([f"`{name}` {kind}" for name, kind in rows.dtypes if name != text_col] + [f"`{out_col}` long"])

    def run(batches):
        encoding = _encoding(file, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, out_col])

    return rows.mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes``: ``op, source, lang, tokenizer, tokens`` and, for ``revise``, ``old_tokens``.

    An insert adds a document and its tokens, a delete takes both away, a revision adds the difference.  A change of source, language or
    tokenizer is a delete and an insert.  Null keys are a key of their own, null counts are 0, rows with another ``op`` raise.  Sums are
    built before the shuffle, so a source with a third of all rows is one row per task.
    """
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).when(F.col("op") == REVISE, 0) \
        .otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
    now, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    signed = changes.select(*KEYS, sign.cast("long").alias("docs"), F.when(F.col("op") == REVISE, now - old).otherwise(sign * now).cast("long").alias("tokens"))
    return signed.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """The committed deltas under one folder of a file system that all executors share."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def forget_at_exit(self):
        """For a rollup that serves one session only: its folder goes when the session ends."""
        self._fs.mkdirs(self._path("commits"))
        self._fs.deleteOnExit(self._path(""))

    def _path(self, name):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _records(self):
        found = self._path("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(found)] if self._fs.exists(found) else []
        return {n[:-5]: json.loads(self._read(f"commits/{n}")) for n in names if n.endswith(".json")}

    def _read(self, name):
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name, record) -> bool:
        """Write a small file unless there is one: of several writers exactly one succeeds, and readers see it whole."""
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        stream.close()
        target, fs = self._path(name), self._jvm.org.apache.hadoop.fs
        self._fs.mkdirs(target.getParent())
        files = fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            files.rename(draft, target, no_overwrite)
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no work, if it was added before.  A run that dies before its record leaves nothing that counts."""
        if not re.fullmatch(r"[A-Za-z0-9_.\-]{1,120}", batch):
            raise ValueError("a batch name has letters, digits, dot, dash and underscore")
        if self._fs.exists(self._path(f"commits/{batch}.json")):
            return False
        data = f"deltas/{batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/{data}")
        return self._create(f"commits/{batch}.json", {"data": data})

    def checkpoint(self, name: str) -> None:
        """Fold all that is committed now into one table, so that totals read one folder and what came after it.

        The records are listed once; a batch that another writer commits meanwhile is neither in the fold's data nor in its list.
        """
        tables, batches = self._tables()
        data = f"deltas/{name}-{uuid.uuid4().hex}"
        self._summed(tables).write.parquet(f"{self.folder}/{data}")
        self._create(f"folds/{name}.json", {"data": data, "batches": batches})

    def _tables(self) -> tuple[list[str], list[str]]:
        """The folders that hold everything committed, and the batches in them, from one listing of the records."""
        folds = []
        found = self._path("folds")
        if self._fs.exists(found):
            folds = [json.loads(self._read(f"folds/{s.getPath().getName()}")) for s in self._fs.listStatus(found)]
        records = self._records()  # after the folds: what a fold holds has a record already
        best = max(folds, key=lambda f: len(f["batches"]), default={"batches": []})
        folded = set(best["batches"])
        return ([best["data"]] if "data" in best else []) + [r["data"] for b, r in sorted(records.items()) if b not in folded], sorted(folded | set(records))

    def _summed(self, tables: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/{t}" for t in tables]) if tables else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups that are back at nothing are left out."""
        return self._summed(self._tables()[0]).filter("docs <> 0 or tokens <> 0")


def counted_documents(docs: DataFrame, file: str, pattern: str, version: str, source_col="source", lang_col="lang", text_col="text", id_col="doc_id") -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` of every document."""
    rows = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    return count_tokens(rows.withColumn("tokenizer", F.lit(version)), file, pattern)
