"""Named signatures, methods and presets, and the whole comparison as one plan."""

import re
from dataclasses import dataclass, field, replace
from typing import Optional

from pyspark.sql import DataFrame, functions as F

from sigloom.model import DEFAULT_BIN_WIDTH, DEFAULT_THETA, relation_code
from sigloom.functions.kernels import method_named
from sigloom.operators import dealing, genes, kmers, metric_join, reports, signatures, sketch, sketch_join, sparse_profiles, taxonomy
from sigloom.operators.pairs import PairJob
from sigloom.session import cut_lineage

BASES = {
    "GC": signatures.gc_signature,
    "freq": signatures.frequency_signature,
    "karl": signatures.karlin_signature,
    "karlL": signatures.karlin_length_signature,
    "exp": signatures.markov_signature,
    "mmzinf": signatures.markov_independent_signature,
    "len": signatures.length_signature,
    "minhash": None,
    "sequence": None,
    "findgene": None,
    "filename": None,
    "none": None,
}
BASIS_ALIASES = {"markz": "exp"}

# --- fixed values -----------------------------------------------------------------------------
PRESETS = {
    "PaSiT4": ("karl", 4, "PaSiT", 0.02),
    "PaSiT6": ("karl", 6, "PaSiT", 0.02),
    "TETRA": ("exp", 4, "pearson", None),
    "approxANI": ("minhash", 21, "approxANI", 21.0),
    "GC": ("GC", 1, "manhattan", None),
}
DEFAULT_BASIS, DEFAULT_K = "karl", 4
LONG_WORDS = 8  # from this word length on, frequencies are kept for the words that occur only
SMALLEST_SKETCH_K = 12  # shorter words fall back to the default sketch word
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SignaturePlan:
    basis: str = DEFAULT_BASIS
    k: int = DEFAULT_K
    double_strand: bool = True
    canonical: bool = False
    sketch_size: int = sketch.DEFAULT_SIZE
    window: Optional[int] = None  # bases: every window of a contig is then compared on its own
    window_step: Optional[int] = None

    @classmethod
    def parse(cls, basis=DEFAULT_BASIS, k=None):
        """A basis as written on the command line: ``karl 4``, ``s_freq 3``, or the older ``karl*6`` and ``freq3``.

        ``s_`` counts a single strand, and so does the older form without a star.
        """
        single = basis.startswith("s_")
        name = basis[2:] if single else basis
        old = re.fullmatch(r"(karl|freq|markz)(\*?)(\d+)", name)
        if old:
            name, single, k = BASIS_ALIASES.get(old[1], old[1]), single or not old[2], int(old[3])
        if name == "TETRA":
            name, k = "exp", 4
        if name not in BASES:
            raise ValueError(f"unknown basis {basis!r}; expected one of {sorted(BASES)}")
        if name == "minhash":
            k = k if k and k > SMALLEST_SKETCH_K else sketch.DEFAULT_K
        return cls(name, int(k or DEFAULT_K), not single)

    def build(self, contigs: DataFrame, gene_panel: DataFrame = None) -> DataFrame:
        """``id, sig`` of every genome."""
        if self.window:
            contigs = kmers.window_genomes(contigs, self.window, self.window_step)
        if self.basis == "minhash":
            return sketch.minhash_signature(contigs, self.k, self.sketch_size)
        if self.basis in ("filename", "none"):
            return contigs.select(F.col("genome_id").alias("id")).distinct().withColumn("sig", F.lit(None).cast("array<double>"))
        if self.basis in ("sequence", "findgene"):
            if gene_panel is None:
                raise ValueError(f"basis {self.basis!r} needs a table of reference genes")
            return genes.gene_signature(genes.find_genes(contigs, gene_panel).select("genome_id", "gene_id", "seq"), gene_panel)
        built = BASES[self.basis](contigs, self.k, self.double_strand)
        return signatures.canonical_signature(built, self.k) if self.canonical else built


@dataclass(frozen=True)
class ComparePlan:
    method: str = "PaSiT"
    theta: Optional[float] = DEFAULT_THETA
    above: Optional[float] = None
    below: Optional[float] = None
    only: Optional[str] = None
    include: tuple = ()
    exclude: tuple = ()
    common_format: bool = False
    include_self: bool = True
    weights: Optional[tuple] = None
    rows_per_tile: Optional[int] = None
    signature: SignaturePlan = field(default_factory=SignaturePlan)

    @classmethod
    def preset(cls, name):
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}; expected one of {sorted(PRESETS)}")
        basis, k, method, theta = PRESETS[name]
        return cls(method=method, theta=theta, include_self=False, signature=SignaturePlan(basis, k))

    def with_(self, **changes):
        return replace(self, **changes)

    def prepare(self, sigs: DataFrame) -> DataFrame:
        """Include/exclude and weights, then the (small) signature table is written once for all later passes."""
        if self.include or self.exclude:
            lineage = "lineage" if "lineage" in sigs.columns else None
            names = [c for c in ("name", "filepath") if c in sigs.columns] or ["id"]
            sigs = taxonomy.include_exclude(sigs, self.include, self.exclude, names, lineage)
        if self.weights:
            sigs = taxonomy.genome_weights(sigs, *self.weights)
        return cut_lineage(sigs)

    def job(self, sigs: DataFrame, queries: DataFrame = None) -> PairJob:
        order = "ord" if "ord" in sigs.columns else None
        return PairJob(
            sigs, self.method, queries=queries, theta=self.theta, order_col=order, low=self.above, high=self.below,
            only=None if self.only is None else relation_code(self.only), include_self=self.include_self,
            common_format=self.common_format, length_tail=self.signature.basis == "karlL",
            sketch_size=self.signature.sketch_size, rows_per_tile=self.rows_per_tile)

    def pairs(self, sigs, queries=None):
        """The wanted pairs; with an upper limit, sketches meet through an index and metric distances through pivots, not all in tiles."""
        sigs = self.prepare(sigs)
        if self.below is not None and not self.common_format:
            name = method_named(self.method).name
            if name == "approxANI" and self.below < 1:
                return self._indexed(sigs, queries, lambda key: sketch_join.neighbours(sigs, self.below, self.theta or sketch.DEFAULT_K, self.signature.sketch_size, queries, key))
            if name in ("manhattan", "PaSiT", "sateucl") and self.below >= 0 and self.signature.basis != "karlL":
                return self._indexed(sigs, queries, lambda key: metric_join.within(sigs, name, self.below, self.theta, queries=queries, id_col=key))
        return self.job(sigs, queries).pairs()

    def _indexed(self, sigs, queries, near):
        """The columns of ``PairJob.pairs``, from ``near`` pairs by input order."""
        ordered, related = "ord" in sigs.columns, "lineage" in sigs.columns
        key = "ord" if ordered else "id"
        found = near(key)
        if self.include_self and queries is None and self.below >= 0:
            own = sigs.where((F.size("sig") > 0) & ~F.exists("sig", lambda x: x.isNull() | F.isnan(x.cast("double")))).select(F.col(key).alias("id_a"), F.col(key).alias("id_b"), F.lit(0.0).alias("dist"))
            found = found.unionAll(own)
        if self.above is not None:
            found = found.where(F.col("dist") >= self.above)
        wanted = ["id_a", "id_b"] + ["ord_a", "ord_b"] * ordered + ["relation"] * related + ["dist"]
        if ordered:
            found = found.withColumnsRenamed({"id_a": "ord_a", "id_b": "ord_b"})
        for end, side in (("a", sigs), ("b", sigs if queries is None else queries)):
            more = [F.col("id").alias(f"id_{end}")] * ordered + [F.col("lineage").alias(f"_lineage_{end}")] * related
            if more:
                column = f"{'ord' if ordered else 'id'}_{end}"
                other = column[:-1] + ("b" if end == "a" else "a")
                found = dealing.dealt_join(found, side.select(F.col(key).alias(column), *more), [column], [other])
        if related:
            found = found.withColumn("relation", taxonomy.relation("_lineage_a", "_lineage_b").cast("int"))
            if self.only is not None:
                found = found.where(F.col("relation") == relation_code(self.only))
        return found.select(*wanted)

    def pairs_of_contigs(self, contigs, queries=None):
        """``id_a, id_b, dist`` straight from contigs: frequencies of long words are compared as sparse profiles, everything else as signatures."""
        signature = self.signature
        if signature.basis != "freq" or signature.k < LONG_WORDS or signature.canonical or signature.window:
            return self.pairs(signature.build(contigs), None if queries is None else signature.build(queries))
        profiles = [None if c is None else sparse_profiles.sparse_profile(kmers.kmer_counts(c, signature.k, double_strand=signature.double_strand, keep_empty=True), share=True)
                    for c in (contigs, queries)]
        found = sparse_profiles.sparse_pairs(profiles[0], self.method, signature.k, self.theta, queries=profiles[1])
        limits = [F.col("dist") >= self.above] * (self.above is not None) + [F.col("dist") <= self.below] * (self.below is not None)
        for limit in limits:
            found = found.where(limit)
        return found

    def ordered(self, sigs, queries=None, by_distance=False):
        found = self.pairs(sigs, queries)
        return reports.by_distance(found, self.common_format) if by_distance else reports.in_input_order(found)

    def histogram(self, sigs, bin_width=DEFAULT_BIN_WIDTH, queries=None):
        hist = self.with_(include_self=False).job(self.prepare(sigs), queries).histogram(bin_width, weighted=bool(self.weights))
        return reports.histogram_table(hist, bin_width)

    def matrix(self, sigs, labels):
        return reports.matrix_lines(self.with_(include_self=True).pairs(sigs), labels)
