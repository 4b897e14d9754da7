import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigloom import cli
from sigloom.operators import signatures as S, taxonomy as T
from sigloom.plans.compare import ComparePlan, SignaturePlan
from sigloom.sources import fasta, file_lists, generators, signature_store as store, taxonomy_files
from sigloom.streaming.search import search_stream

FASTA = "junk\r\n>one first\r\nACGT\r\nAC\r\n>two\nacgu\n>three\n\n>four\nACGR\n"
WANTED = [(None, "junk"), ("one first", "ACGTAC"), ("two", "acgu"), ("three", ""), ("four", "ACGR")]


@pytest.mark.parametrize("reader", [fasta.read_fasta, fasta.read_large_fasta])
def test_fasta(spark, tmp_path, reader):
    (tmp_path / "a.fasta").write_bytes(FASTA.encode())
    (tmp_path / "b.fasta").write_text(">x\nA>C\n")
    rows = reader(spark, str(tmp_path / "*.fasta")).orderBy("path", "ord").collect()
    assert [(r["name"], r["seq"]) for r in rows] == WANTED + [("x", "A>C")]


def test_empty_fasta(spark, tmp_path):
    (tmp_path / "e.fasta").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path)).count() == 0


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(held, ("700", "0")):
        spark.conf.set(key, value)
    yield
    for key, value in held.items():
        spark.conf.set(key, value)


def _large_files(folder):
    """A file of many small byte ranges, with a record longer than several of them, one on one line, odd line ends, and neighbours of all sizes."""
    rng = random.Random(8)
    base = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    lines = ["lead"]
    for i in range(60):
        lines.append(f">r{i} of {'x' * (i % 9)}")
        seq = base(9_000 if i == 20 else 0 if i % 13 == 5 else rng.randint(1, 900))
        lines += [seq] if i == 33 else [seq[at:at + 60] + "\r" * (i % 2) for at in range(0, len(seq), 60)] + [""] * (i % 3)
    (folder / "a.fna").write_text("\n".join(lines))
    (folder / "b.fna").write_text(">only\nACGT\n>\n>last")
    (folder / "c.fna").write_text("")
    return str(folder / "*.fna")


@pytest.mark.parametrize("piece", [50, 1 << 22])
def test_files_in_byte_ranges_equal_whole_files(spark, tmp_path, small_splits, piece):
    paths = _large_files(tmp_path)
    assert spark.read.option("lineSep", "\n").text(paths).rdd.getNumPartitions() >= 40
    want = sorted(tuple(r) for r in fasta.read_fasta(spark, paths).select("path", "ord", F.coalesce("name", F.lit("-")), "seq").collect())
    assert sorted(tuple(r) for r in fasta.read_large_fasta(spark, paths, piece).select("path", "ord", F.coalesce("name", F.lit("-")), "seq").collect()) == want


@pytest.mark.parametrize("k,piece", [(1, 50), (11, 3)])
def test_pieces_hold_every_word_once(spark, tmp_path, small_splits, k, piece):
    paths = _large_files(tmp_path)
    whole = {(r["path"], r["ord"]): r for r in fasta.read_fasta(spark, paths).collect()}
    words, longest = Counter(), 0
    for r in fasta.read_fasta_pieces(spark, paths, k, piece).collect():
        seq = whole[r["path"], r["ord"]]["seq"]
        assert r["name"] == whole[r["path"], r["ord"]]["name"] and seq[r["offset"]:r["offset"] + len(r["seq"])] == r["seq"]
        longest = max(longest, len(r["seq"]))
        words.update((r["path"], r["ord"], r["offset"] + i) for i in range(len(r["seq"]) - k + 1))
    assert words == Counter((*at, i) for at, r in whole.items() for i in range(len(r["seq"]) - k + 1))
    assert longest < 9_000 or piece > 9_000


def test_filter_and_validation(spark):
    df = spark.createDataFrame([("a", "ACGU"), ("b", "ACGR"), ("c", "A")], "name string, seq string")
    got = {r["name"]: (r["seq"], r["valid"]) for r in fasta.validate(fasta.filter_short(df, 2)).collect()}
    assert got == {"a": ("ACGT", True), "b": ("", False)}
    masked = fasta.validate(df, strict=False).where("name = 'b'").first()
    assert masked["seq"] == "ACGN" and masked["valid"] is False


def test_file_list_order(spark, tmp_path):
    listing = tmp_path / "files.list"
    listing.write_text("b.fa\n\na.fa\n")
    got = file_lists.listed_files(spark, str(listing), ["z.fa"], "q.fa").orderBy("ord")
    assert [r["path"] for r in got.collect()] == ["b.fa", "a.fa", "z.fa", "q.fa"]
    assert file_lists.existing(spark, [str(listing), "/no/such/file"]) == [str(listing)]


def test_lineage_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("g1\td__B;p__P;c__C\n")
    (tmp_path / "p.csv").write_text("g2,AbcDefGhiJkl_Mno_pqr_x_y\ng3,Genus species\n")
    gtdb = taxonomy_files.read_lineages(spark, str(tmp_path / "g.tsv")).first()
    assert gtdb["lineage"][:3] == ["k__B", "p__P", "c__C"] and gtdb["lineage"][3] is None
    pcof = {r["name"]: r["lineage"] for r in taxonomy_files.read_lineages(spark, str(tmp_path / "p.csv"), "PCOF_S").collect()}
    assert pcof["g2"] == [None, "p__Abc", "c__Def", "o__Ghi", "f__Jkl", "g__Mno", "s__pqr", "t__x", "i__y"]
    assert pcof["g3"][5:7] == ["g__Genus", "s__species"]


def test_ncbi_files(spark, tmp_path):
    dump = lambda rows: "".join("\t|\t".join(r) + "\t|\n" for r in rows)
    (tmp_path / "nodes.dmp.txt").write_text(dump([("1", "1", "no rank"), ("2", "1", "Domain"), ("5", "2", "phylum"), ("6", "5", "clade"), ("9", "6", "species")]))
    (tmp_path / "merged.dmp.txt").write_text(dump([("8", "9")]))
    (tmp_path / "names.dmp.txt").write_text(dump([("9", "Some bug", "", "scientific name"), ("9", "Bug", "", "synonym")]))
    (tmp_path / "leaves.csv").write_text("s1,9\ns2,8\ns3,5\n")
    paths = [str(tmp_path / f"{n}.dmp.txt") for n in ("nodes", "merged", "names")]
    got = {r["name"]: r["lineage"] for r in taxonomy_files.read_ncbi_lineages(spark, str(tmp_path / "leaves.csv"), *paths).collect()}
    assert got["s1"][1] == got["s2"][1] == "5" and got["s1"][6] == "9" and got["s2"][6] == "8" and got["s3"][6] is None and got["s1"][8] == "s1"
    tree = taxonomy_files.read_ncbi_tree(spark, *paths)
    assert tree.where("name = '9'").first()["label"] == "Some bug"
    taxonomy_files.save_tree(tree, str(tmp_path / "tree"))
    assert taxonomy_files.load_tree(spark, str(tmp_path / "tree")).count() == tree.count()


def test_cycle_is_reported(spark):
    nodes = spark.createDataFrame([("a", 1.0, "b"), ("b", 2.0, "a")], "name string, level double, parent string")
    with pytest.raises(ValueError):
        T.ancestor_lineages(nodes, max_rounds=3)


def test_binary_signatures(spark, tmp_path):
    one, two = store.binary_record("a", "KARLIN", [1.0, 2.5]), store.binary_record("b", "KARLIN", [3.0])
    muxed = struct.pack("<HHHQQQ", 0, store.KINDS.index("MUXED"), store.TYPES.index("MUXED"), 2, len(one + two), 0) + one + two
    (tmp_path / "x.sdb").write_bytes(struct.pack("<i", store.MAGIC) + muxed)
    legacy = struct.pack("<iQ2dq", 3, 2, 7.0, 8.0, 1) + b"z"
    (tmp_path / "y.sig").write_bytes(legacy)
    (tmp_path / "z.sig").write_bytes(struct.pack("<q", 2) + legacy + struct.pack("<iQ2bq", 2, 2, 1, 2, 1) + b"w")
    rows = store.read_binary(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r["name"], r["sig"]) for r in rows] == [("a", [1.0, 2.5]), ("b", [3.0]), ("z", [7.0, 8.0]), ("z", [7.0, 8.0]), ("w", [1.0, 2.0])]
    files = store.binary_files(spark.createDataFrame([("q", [4.0])], "name string, sig array<double>"), "GC").first()
    assert store.parse_binary(bytes(files["content"])) == [("q", "GC", [4.0])]
    text = spark.createDataFrame([(bytearray(b">a\nACGT\n"),), (bytearray(b"\x00\x00SG"),)], "content binary").select(store.is_text("content")).collect()
    assert [r[0] for r in text] == [True, False]


def _collection(order, records, inner=()):
    """A collection whose last member is a collection of ``inner``."""
    head = lambda kind, n, size, label: struct.pack(order + store.HEADER, 0, store.KINDS.index(kind), store.TYPES.index("MUXED" if kind == "MUXED" else "DBL"), n, size, label)
    leaf = lambda name, values: head("KARLIN", len(values), 8 * len(values), len(name.encode())) + name.encode() + struct.pack(f"{order}{len(values)}d", *values)
    bodies = [leaf(*r) for r in records] + ([head("MUXED", len(inner), len(inner), 3) + b"sub" + b"".join(leaf(*r) for r in inner)] if inner else [])
    return struct.pack(order + "i", store.MAGIC) + head("MUXED", len(bodies), len(bodies), 0) + b"".join(bodies)


@pytest.mark.parametrize("order", ["<", ">"])
def test_large_collection_is_read_in_ranges(spark, tmp_path, order):
    records = [(f"g {i}", [float(i + j) for j in range(i % 7)]) for i in range(10_000)]
    inner = [("x", [1.5]), ("é", [])]
    data = _collection(order, records, inner)
    (tmp_path / "big one.sdb").write_bytes(data)
    found = store.read_binary(spark, str(tmp_path / "big one.sdb"), split_bytes=20_000)
    rows = found.withColumn("task", F.spark_partition_id()).orderBy("pos").collect()
    assert [(r["name"], r["kind"], r["sig"]) for r in rows] == store.parse_binary(data)
    assert [r["pos"] for r in rows] == list(range(10_002)) and len({r["task"] for r in rows}) > 10


def test_broken_collections_raise(spark, tmp_path):
    (tmp_path / "cut.sdb").write_bytes(_collection("<", [("a", [1.0, 2.0]), ("b", [3.0])])[:-4])
    (tmp_path / "foreign.sdb").write_bytes(b"\xff" * 64)
    (tmp_path / "empty.sdb").write_bytes(b"")
    for name in ("cut", "foreign"):
        with pytest.raises(Exception, match="signature|unpack"):
            store.read_binary(spark, str(tmp_path / f"{name}.sdb")).collect()
    assert store.read_binary(spark, str(tmp_path / "empty.sdb")).count() == 0


def test_text_and_saved_signatures(spark, tmp_path):
    sigs = spark.createDataFrame([("g", [0.0, 0.5, 123.456789, 2.5e9, -3e-9])], "name string, sig array<double>")
    assert store.text_lines(sigs, "Karlin").first()["line"] == "g.Karlin,0,0.500000,123.4568,2.500000e+09,-3.000000e-09"
    assert store.save_signatures(sigs, str(tmp_path / "s")) and not store.save_signatures(sigs, str(tmp_path / "a"), "average")
    assert store.load(spark, str(tmp_path / "s")).first()["sig"][1] == 0.5


def test_basis_names():
    assert SignaturePlan.parse("karl") == SignaturePlan("karl", 4, True)
    assert SignaturePlan.parse("s_freq", 3) == SignaturePlan("freq", 3, False)
    assert SignaturePlan.parse("karl*6") == SignaturePlan("karl", 6, True) and SignaturePlan.parse("freq3") == SignaturePlan("freq", 3, False)
    assert SignaturePlan.parse("minhash", 9).k == 21
    assert ComparePlan.preset("GC").method == "manhattan"
    with pytest.raises(ValueError):
        ComparePlan.preset("combinedSpecies")


@pytest.fixture
def genomes(spark, tmp_path):
    seqs = generators.random_sequences(spark, 4, 300, seed=3).collect()
    assert len({r["seq"] for r in seqs}) == 4 and all(set(r["seq"]) == set("ACGT") for r in seqs)
    paths = []
    for r in seqs:
        path = tmp_path / f"g{r['id']}.fasta"
        path.write_text(f">c\n{r['seq']}\n")
        paths.append(str(path))
    (tmp_path / "tax.tsv").write_text("".join(f"g{i}.fasta\td__B;p__P{i % 2}\n" for i in range(4)))
    return tmp_path, paths


def lines(path):
    return [l for part in sorted(path.glob("part-*")) for l in part.read_text().splitlines()]


def test_command_line(spark, genomes):
    folder, paths = genomes
    def call(name, *options):
        cli.run(spark, cli.parser().parse_args([*options, "-l", "10", "-o", str(folder / name), *paths]))
        return lines(folder / name)
    listed = [l for l in call("list", "-t", str(folder / "tax.tsv"), "GTDB", "--ordered") if not l.startswith("File1")]
    assert [l.split(",")[:3] for l in listed] == [[f"g{i}.fasta", f"g{j}.fasta", "Same_Phylum" if (i - j) % 2 == 0 else "Different_Phyla"] for i in range(4) for j in range(i + 1, 4)]
    for name, options in (("plain", []), ("ward", ["-u", "ward"]), ("single", ["-u", "single"]), ("sorted", ["-r"]), ("both", ["-r", "-u", "ward"])):
        head, *matrix = call(name, "-x", *options)
        order = head.split(",")[1:]
        assert head.startswith(",") and sorted(order) == [f"g{i}.fasta" for i in range(4)] and [l.split(",")[0] for l in matrix] == order
        assert all(l.split(",")[i + 1] == "0.000000" for i, l in enumerate(matrix))
        if "-r" not in options:
            assert order == [f"g{i}.fasta" for i in range(4)]
        assert (folder / f"{name}.tre").exists() == ("-u" in options)
    assert "".join(lines(folder / "single.tre")).count("(") == 3
    assert len([l for l in call("search", "-s", paths[0]) if not l.startswith("File1")]) == 4
    hist = call("hist", "-g", "0.1", "-b", "freq", "2")
    assert sum(float(x) for l in hist if l[0].isdigit() for x in l.split(",")[1:]) == 6


def test_command_line_reads_saved_signatures(spark, genomes):
    folder, paths = genomes
    sigs = S.frequency_signature(fasta.as_genomes(fasta.read_fasta(spark, paths), 10), 2)
    made = {r["name"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in store.binary_files(sigs.withColumnRenamed("id", "name"), "FREQPROF").collect()}
    saved = []
    for name, content in sorted(made.items()):
        saved.append(str(folder / f"{name}.sig"))
        (folder / f"{name}.sig").write_bytes(content)
    bodies = [made[k][4:] for k in sorted(made)]
    collection = struct.pack("<i", store.MAGIC) + struct.pack("<" + store.HEADER, 0, store.KINDS.index("MUXED"), store.TYPES.index("MUXED"), 4, 4, 0) + b"".join(bodies)
    (folder / "all.sdb").write_bytes(collection)
    def call(name, inputs):
        cli.run(spark, cli.parser().parse_args(["-b", "freq", "2", "-m", "manhattan", "--ordered", "-l", "10", "-o", str(folder / name), *inputs]))
        return sorted(l.split(",")[3] for l in lines(folder / name) if not l.startswith("File1"))
    fresh = call("fresh", paths)
    assert len(fresh) == 6 and call("one_each", saved) == fresh and call("together", [str(folder / "all.sdb")]) == fresh
    assert call("mixed", [paths[0], *saved[1:]]) == fresh


def test_streaming_search(spark, tmp_path):
    schema = "genome_id long, seq string"
    seqs = generators.random_sequences(spark, 3, 100).select(F.col("id").alias("genome_id"), "seq")
    saved = S.frequency_signature(seqs, 2)
    seqs.where("genome_id = 1").write.parquet(str(tmp_path / "in"))
    plan = ComparePlan(method="manhattan", signature=SignaturePlan("freq", 2))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    search_stream(stream, saved, plan, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1)} and got[1, 1] == 0.0


def test_external_hits(spark):
    from sigloom.operators.genes import tabular_identity
    from sigloom.sources.external import tabular_hits

    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "query string, target string")
    hits = tabular_hits(pairs, ["printf", "{query}\t{target}\t90\t100\n{query}\t{target}\t80\t300\n"])
    got = tabular_identity(hits).first()
    assert (got["id_a"], got["id_b"]) == ("a", "b") and got["dist"] == pytest.approx((0.1 * 100 + 0.2 * 300) / 400)


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", "ACGT"), ("y", "GGN")], "name string, seq string").coalesce(1)
    fasta.write_fasta(df, str(tmp_path / "f"))
    assert [(r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "f" / "*.txt")).orderBy("ord").collect()] == [("x", "ACGT"), ("y", "GGN")]
    fasta.write_fastq(df, str(tmp_path / "q"))
    assert (lines(tmp_path / "q"))[:4] == ["@x", "ACGT", "+", "5555"]
