"""Command line:  python -m sigloom.cli [options] genome.fasta …"""

import argparse
import logging

from pyspark.sql import functions as F

from sigloom import __version__
from sigloom.model import DEFAULT_BIN_WIDTH, DEFAULT_MIN_CONTIG, DEFAULT_THETA
from sigloom.operators import cluster, reports, taxonomy
from sigloom.plans.compare import ComparePlan, SignaturePlan
from sigloom.session import build_session, cut_lineage
from sigloom.sources import fasta, file_lists, signature_store, taxonomy_files

log = logging.getLogger("sigloom")
LEVELS = {"all": logging.CRITICAL + 1, "errors": logging.ERROR, "warnings": logging.WARNING, "progress": logging.INFO}


def parser():
    p = argparse.ArgumentParser(prog="sigloom", description="Compare sequence collections by their signatures.")
    p.add_argument("inputs", nargs="*")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-b", "--basis", nargs="+", metavar=("NAME", "K"))
    p.add_argument("-m", "--method", nargs="+", metavar=("NAME", "PARAMETER"))
    p.add_argument("-p", "--preset")
    p.add_argument("-f", "--filelist")
    p.add_argument("-s", "--search", nargs="?", const="", help="query file or saved table; the last input when no file is named")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-t", "--taxonomy", nargs=2, metavar=("FILE", "FORM"))
    p.add_argument("--genes", help="FASTA file of reference genes for the findgene and sequence bases")
    p.add_argument("-g", "--histogram", nargs="?", type=float, const=DEFAULT_BIN_WIDTH)
    p.add_argument("-x", "--distancematrix", action="store_true")
    p.add_argument("-d", "--ordered", action="store_true")
    p.add_argument("-r", "--sort_by_distance", action="store_true")
    p.add_argument("-w", "--below", type=float)
    p.add_argument("-v", "--above", type=float)
    p.add_argument("-y", "--only")
    p.add_argument("-l", "--filtershort", type=int, default=DEFAULT_MIN_CONTIG)
    p.add_argument("-k", "--keepsigs", choices=signature_store.SAVE_MODES)
    p.add_argument("-c", "--canonical", action="store_true")
    p.add_argument("-a", "--filealias")
    p.add_argument("-e", "--exclude", nargs="*", default=[])
    p.add_argument("-i", "--include", nargs="*", default=[])
    p.add_argument("-u", "--clustering", choices=("ward", "single"))
    p.add_argument("--genome_weights", nargs=2, metavar=("RANK", "APPROACH"))
    p.add_argument("--common_format", action="store_true")
    p.add_argument("-q", "--quiet", choices=sorted(LEVELS), default="progress")
    p.add_argument("--master")
    return p


def plan_of(args) -> ComparePlan:
    if args.preset:
        plan = ComparePlan.preset(args.preset)
    else:
        basis = SignaturePlan.parse(args.basis[0], int(args.basis[1]) if len(args.basis) > 1 else None) if args.basis else SignaturePlan()
        method = args.method or ["PaSiT"]
        theta = float(method[1]) if len(method) > 1 else {"approxANI": 21.0}.get(method[0], DEFAULT_THETA)
        plan = ComparePlan(method=method[0], theta=theta, signature=basis)
    signature = plan.signature if not args.canonical else SignaturePlan(**{**plan.signature.__dict__, "canonical": True})
    return plan.with_(
        above=args.above, below=args.below, only=args.only, include=tuple(args.include), exclude=tuple(args.exclude),
        common_format=args.common_format, weights=tuple(args.genome_weights) if args.genome_weights else None,
        include_self=not (args.ordered or args.sort_by_distance), signature=signature)


SAVED = (".sig", ".sdb")
_IN_FILE = 1 << 34  # places in the order that a file with several signatures has


def _bare(path):
    return F.regexp_replace(path, "^file:/*", "/")


def _built(spark, paths, plan, args):
    """``filepath, pos, name, sig`` of sequence files."""
    contigs = fasta.validate(fasta.filter_short(fasta.read_large_fasta(spark, paths), args.filtershort)).withColumn("genome_id", F.col("path"))
    panel = None
    if args.genes:
        panel = fasta.validate(fasta.read_fasta(spark, args.genes)).select(F.col("ord").alias("gene_id"), F.col("seq").alias("gene"))
    sigs = plan.signature.build(contigs, panel).withColumn("filepath", _bare("id"))
    return sigs.select("filepath", F.lit(0).cast("long").alias("pos"), fasta.genome_name("filepath").alias("name"), "sig")


def _loaded(spark, paths):
    """``filepath, pos, name, sig`` of saved signatures; one file may hold many."""
    found = signature_store.read_binary(spark, paths).withColumn("filepath", _bare("path"))
    return found.select("filepath", "pos", F.when(F.col("name") != "", F.col("name")).otherwise(fasta.genome_name("filepath")).alias("name"), "sig")


def signatures_of(spark, files, plan, args):
    """``id, name, filepath, ord, sig[, lineage]`` of the listed genomes, from sequences or from saved signature files."""
    paths = [r["path"] for r in files.orderBy("ord").select("path").toLocalIterator()]
    present = file_lists.existing(spark, paths)
    for missing in sorted(set(paths) - set(present)):
        log.warning("%s does not exist and is skipped", missing)
    if not present:
        raise SystemExit("no input files")
    saved = [p for p in present if p.lower().endswith(SAVED)]
    fresh = [p for p in present if not p.lower().endswith(SAVED)]
    parts = ([_built(spark, fresh, plan, args)] if fresh else []) + ([_loaded(spark, saved)] if saved else [])
    sigs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = files.select(_bare("path").alias("_p"), F.col("ord").alias("_file"))
    sigs = sigs.join(order, sigs["filepath"] == order["_p"]).withColumn("ord", F.col("_file") * _IN_FILE + F.col("pos")).drop("_p", "_file", "pos")
    if args.taxonomy:
        path, form = args.taxonomy
        if form == "NCBI":
            folder = path.rsplit("/", 1)[0] if "/" in path else "."
            files_of = {n: f"{folder}/{n}.dmp.txt" for n in ("nodes", "merged", "names")}
            have = set(file_lists.existing(spark, list(files_of.values())))
            lineages = taxonomy_files.read_ncbi_lineages(
                spark, path, files_of["nodes"], *(files_of[n] if files_of[n] in have else None for n in ("merged", "names")))
        else:
            lineages = taxonomy_files.read_lineages(spark, path, form)
        sigs = taxonomy.assign_lineage(sigs, lineages)
    if args.filealias:
        sigs = taxonomy.apply_name_aliases(sigs, taxonomy_files.read_aliases(spark, args.filealias))
    return sigs.withColumn("id", F.col("ord"))


def _clustered(args, pairs, ranked, names):
    """Write the tree that ``-u`` asks for, and give the order of the matrix: that of single linkage with ``-r``, else unchanged."""
    leaves = ranked.select(F.col("ord").alias("id"), F.col("id").alias("_raw")).join(names.withColumnRenamed("id", "_raw"), "_raw")
    dense = ranked.select("id", F.col("ord").alias("_n"))
    ends = [dense.select(F.col("id").alias(f"id_{e}"), F.col("_n").alias(f"n{e}")) for e in "ab"]
    off = cut_lineage(pairs.where(F.col("id_a") != F.col("id_b")).join(ends[0], "id_a").join(ends[1], "id_b").select(
        F.col("na").alias("id_a"), F.col("nb").alias("id_b"), "dist"))
    n, single = leaves.count(), None
    if args.sort_by_distance or args.clustering == "single":
        single = cluster.single_linkage(off, leaves, n)
        found = cluster.single_linkage_clusters(single).first() if not single.isEmpty() else None
        log.info("the matrix seems to have about %d clusters", found["clusters"] if found else n)
    if args.clustering:
        merges = single if args.clustering == "single" else cluster.ward_linkage(off, leaves)
        branches = cluster.ward_branches(merges, n) if args.clustering == "ward" else None
        if args.clustering == "ward":
            ratios = cluster.ward_f_statistic(off, leaves, merges)
            log.info("the tree seems to have about %d clusters", cluster.ward_cluster_count(ratios, leaves).first()["clusters"])
        cluster.write_newick(cluster.newick_tokens(merges, leaves, n, branches), f"{args.output}.tre")
    if not args.sort_by_distance:
        return ranked
    places = cluster.leaf_order(single, leaves, n).withColumnRenamed("id", "_n")
    return dense.join(places, "_n").select("id", F.col("pos").alias("ord"))


def run(spark, args):
    plan = plan_of(args)
    inputs = list(args.inputs)
    search = args.search
    if search == "":
        search = inputs.pop()
    sigs = cut_lineage(signatures_of(spark, file_lists.listed_files(spark, args.filelist, inputs), plan, args))
    if args.keepsigs and not signature_store.save_signatures(sigs, f"{args.output}.signatures", args.keepsigs, signature_store.KIND_OF_BASIS.get(plan.signature.basis, "UNKNOWN")):
        return
    queries = None
    if search and search.endswith(".signatures"):
        saved = signature_store.load(spark, search)
        queries = saved.withColumn("ord", F.col("ord") + file_lists.SEARCH_OFFSET * _IN_FILE).withColumn("id", F.col("ord"))
    elif search:
        queries = signatures_of(spark, file_lists.listed_files(spark, search=search), plan, args)
    names = sigs.select("id", "name") if queries is None else sigs.select("id", "name").unionByName(queries.select("id", "name"))

    if args.histogram is not None:
        plan.histogram(sigs, args.histogram, queries).orderBy("bin").drop("bin").write.mode("overwrite").csv(args.output, header=True)
    elif args.distancematrix and queries is None:
        prepared = plan.prepare(sigs)
        pairs = cut_lineage(plan.with_(include_self=True, include=(), exclude=(), weights=None).job(prepared).pairs())
        ranked = cluster._ranked(prepared.select(F.col("ord").alias("dist"), F.col("id").alias("id_a"), F.lit(0).alias("id_b"))).select(
            F.col("id_a").alias("id"), F.col("rank").alias("ord"))
        if args.clustering or args.sort_by_distance:
            ranked = _clustered(args, pairs, ranked, names)
        labels = ranked.join(names, "id")
        lines = reports.matrix_header(labels).unionByName(reports.matrix_lines(pairs, labels))
        lines.orderBy("ord").select("line").write.mode("overwrite").text(args.output)
    else:
        found = plan.pairs(sigs, queries)
        a, b = (names.select(F.col("id").alias(f"ord_{e}"), F.col("name").alias(f"id_{e}")) for e in "ab")
        found = found.withColumnsRenamed({"id_a": "ord_a", "id_b": "ord_b"}) if "ord_a" not in found.columns else found.drop("id_a", "id_b")
        found = found.join(a, "ord_a").join(b, "ord_b")
        if args.ordered or args.sort_by_distance:
            found = reports.by_distance(found, args.common_format) if args.sort_by_distance else reports.in_input_order(found)
        printed = reports.pair_list(found)
        if args.ordered or args.sort_by_distance:
            printed = printed.withColumnRenamed("Distance", "Similarity" if args.common_format else "Distance")
        printed.write.mode("overwrite").csv(args.output, header=True)


def main(argv=None):
    args = parser().parse_args(argv)
    logging.basicConfig(level=LEVELS[args.quiet], format="%(levelname)s %(message)s")
    spark = build_session(master=args.master)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, args)


if __name__ == "__main__":
    main()
