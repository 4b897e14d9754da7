"""From raw documents to packed training sequences: five stages, each over all rows that the one before kept."""

from sigloom.llm import exact_dedup, ngram_join, packing, pii, quality
from sigloom.llm.common import Written
from sigloom.session import ship_package


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the rules go, and lines that a host repeats too often; the character count follows."""
    ship_package(spark)
    return quality.keep_good(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def exact_copies(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    ship_package(spark)
    return ngram_join.drop_near_copies(docs)


def personal_data(spark, docs, sf_dir):
    """Personal data in the texts is replaced by surrogates; the character count follows."""
    ship_package(spark)
    return pii.rewrite(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packed_sequences(spark, docs, sf_dir):
    """Each document's place in the training sequences, in tokens of a byte vocabulary."""
    ship_package(spark)
    return packing.pack_documents(packing.utf8_lengths(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("PII surrogates", personal_data),
    ("best-fit packing", packed_sequences),
]

#: Neither surrogates nor packing can be expressed in SQL; the tests hold both against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of a folder; each result is written and read again before the next stage."""
    written = Written(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written.table(docs)
    return docs
