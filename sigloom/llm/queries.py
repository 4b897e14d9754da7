"""One query per operator over the whole tables, and SQL for the same rows where SQL can express them."""

import os
import uuid

from pyspark.sql import functions as F

from sigloom.llm import chat, exact_dedup, lbl, ngram_join, packing, pii, prefix_trie, quality, sharding, spiece, token_counts, toxicity, whitening
from sigloom.llm.common import pick
from sigloom.llm.sql import CHAT, EXACT_DEDUP, NEAR_COPIES, QUALITY, prefix_trie_sql, sharding_sql
from sigloom.session import cut_lineage, ensure_checkpoint_dir

SHARDS = 24
#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: How the byte-level vocabulary cuts a text before merging: a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VERSION = "byte_bpe_50k"


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_rollup(spark, folder):
    """All documents come in; those labelled low in quality go again; those labelled toxic are revised to have no tokens; each batch is sent twice."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    counted = token_counts.counted_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN, VERSION)
    marks = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.forget_at_exit()
    none = F.lit(None).cast("long")
    counted = cut_lineage(counted)
    marked = counted.join(marks, "doc_id")
    loaded = counted.withColumns({"op": F.lit(token_counts.INSERT), "old_tokens": none})
    dropped = marked.filter("quality = 0").withColumns({"op": F.lit(token_counts.DELETE), "old_tokens": none})
    revised = marked.filter("quality = 1 and toxic = 1").withColumns({"op": F.lit(token_counts.REVISE), "old_tokens": F.col("tokens"), "tokens": F.lit(0).cast("long")})
    for batch, changes in (("load", loaded), ("load", loaded), ("quality", dropped), ("toxic", revised), ("quality", dropped)):
        rollup.commit(batch, changes)
    return rollup.totals()


def op2_best_fit(spark, folder):
    """Every document in training sequences, counted in tokens of the byte vocabulary."""
    return packing.pack_documents(packing.utf8_lengths(_table(spark, folder, "documents")))


def op3_feistel_shards(spark, folder):
    """Every row in one of the shards; a NULL text counts 8 bytes, repeated rows each get a place of their own, and an empty table gives no rows."""
    return sharding.shard_rows(_table(spark, folder, "documents"), SHARDS)


def op4_ngram_jaccard(spark, folder):
    """One row per document; a text that is NULL or has no words has an empty set and stands alone, one of fewer than five words has a single shingle."""
    return ngram_join.near_copies(_table(spark, folder, "documents"))


def op5_pieces(spark, folder):
    """The ids of every text, with the round trip and the comparison with the model's own library."""
    docs = _table(spark, folder, "documents")
    coded = spiece.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip", "parity")


def op6_preference_pairs(spark, folder):
    """Preference pairs from all conversations: the last answer against the one before."""
    out = chat.format_pairs(chat.stale_answer_pairs(_table(spark, folder, "conversations")))
    return out.withColumns({name: chat.spans_text(out[name]) for name in ("chosen_spans", "rejected_spans")})


def op7_exact_copies(spark, folder):
    """One row per document; a NULL text counts as empty, and of equal texts the longest original, then the smallest doc_id, stays."""
    return exact_dedup.group_copies(_table(spark, folder, "documents"))


def op8_line_frequency(spark, folder):
    """One row per document; a NULL text has no words and fails."""
    return quality.judge(_table(spark, folder, "documents"))


def op9_weighted_lexicon(spark, folder):
    """One row per document; empty texts are scored too."""
    return toxicity.score_by_labels(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_surrogates(spark, folder):
    """What is replaced in every document."""
    return pii.report(_table(spark, folder, "documents"))


def op11_whitening(spark, folder):
    """Leading components of all vectors; those that are NULL or hold NULL or non-finite entries are left out."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_prefix_trie(spark, folder):
    """All prefixes of the rebuilt conversations; a NULL role or text counts as empty, a NULL turn comes first."""
    return prefix_trie.conversation_trie(_table(spark, folder, "conversations"), rebuild=True)


def op13_log_bilinear(spark, folder):
    """One row per document; a NULL text counts as empty and is its end alone."""
    return lbl.score(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_rollup, op2_best_fit, op3_feistel_shards, op4_ngram_jaccard, op5_pieces, op6_preference_pairs, op7_exact_copies, op8_line_frequency,
                                  op9_weighted_lexicon, op10_surrogates, op11_whitening, op12_prefix_trie, op13_log_bilinear)}
SQL = {
    "op3_feistel_shards": sharding_sql(sharding.round_keys(0), sharding.PRIME, *sharding.MULTIPLIERS, SHARDS),
    "op4_ngram_jaccard": NEAR_COPIES,
    "op6_preference_pairs": CHAT,
    "op7_exact_copies": EXACT_DEDUP,
    "op8_line_frequency": QUALITY,
    "op12_prefix_trie": prefix_trie_sql(100, 6),
}
