"""Signature bases: contigs in, one ``id, sig`` row per genome out."""

from pyspark.sql import DataFrame, functions as F

from sigloom.functions import composition
from sigloom.operators import kmers


def counts_signature(contigs: DataFrame, k=4, double_strand=True) -> DataFrame:
    """Dense k-mer counts; a genome without any k-mer keeps an all-zero vector."""
    counts = kmers.kmer_counts(contigs, k, double_strand=double_strand, keep_empty=True)
    return kmers.dense_profile(counts, k).withColumnRenamed("genome_id", "id")


def frequency_signature(contigs, k=4, double_strand=True):
    """Shares of the k-mers; a genome without any keeps an all-zero vector."""
    counts = kmers.kmer_counts(contigs, k, double_strand=double_strand, keep_empty=True)
    return kmers.dense_profile(counts, k, share=True).withColumnRenamed("genome_id", "id")


def karlin_signature(contigs, k=4, double_strand=True):
    return counts_signature(contigs, k, double_strand).select("id", composition.karlin_profile("sig", k).alias("sig"))


def karlin_length_signature(contigs, k=4, double_strand=True):
    """Karlin profile followed by the number of k-mers of the genome."""
    counts = counts_signature(contigs, k, double_strand)
    total = F.aggregate("sig", F.lit(0.0), lambda s, x: s + x)
    return counts.select("id", F.concat(composition.karlin_profile("sig", k), F.array(total)).alias("sig"))


def markov_signature(contigs, k=4, double_strand=True):
    _at_least_three(k)
    return counts_signature(contigs, k, double_strand).select("id", composition.markov_profile("sig", k).alias("sig"))


def markov_independent_signature(contigs, k=4, double_strand=True):
    _at_least_three(k)
    counts = kmers.kmer_counts_of(contigs, (k, k - 1, k - 2), double_strand=double_strand)
    held = counts.groupBy("genome_id").agg(F.collect_list(F.struct("k", "code", F.col("n").cast("double").alias("v"))).alias("held"))
    return composition.markov_from_counts(held, k).withColumnRenamed("genome_id", "id")


def gc_signature(contigs, k=1, double_strand=True):
    return kmers.gc_content(contigs).select(F.col("genome_id").alias("id"), F.array("gc").alias("sig"))


def length_signature(contigs, k=1, double_strand=True):
    return kmers.genome_length(contigs).select(
        F.col("genome_id").alias("id"), F.array(F.col("length").cast("double")).alias("sig"))


def presence_signature(contigs, k=4, double_strand=True):
    return presence_absence(counts_signature(contigs, k, double_strand))


def presence_absence(sigs: DataFrame) -> DataFrame:
    return sigs.withColumn("sig", F.transform("sig", lambda x: (x != 0).cast("double")))


def canonical_signature(sigs: DataFrame, k) -> DataFrame:
    """Drop the elements whose reverse complement has a smaller code."""
    def keep(_, i):
        text = kmers.kmer_text(i.cast("long"), k)
        return text <= F.reverse(F.translate(text, "ACGT", "TGCA"))
    return sigs.withColumn("sig", F.filter("sig", keep))


def _at_least_three(k):
    if k < 3:
        raise ValueError("a Markov expectation needs k >= 3")
