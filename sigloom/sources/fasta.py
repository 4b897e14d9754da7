"""FASTA input: files to contigs, contigs to genomes."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sigloom.functions import sequences as Q
from sigloom.model import DEFAULT_MIN_CONTIG
from sigloom.session import cut_lineage

PIECE = 1 << 22  # bases of a record that one row holds at most while a large file is read


def parse_texts(texts: DataFrame, keep=("path",), text_col="value") -> DataFrame:
    """``…keep, ord, name, seq`` from whole FASTA texts.

    A ``>`` at the start of a line opens a record, its header is kept without the ``>``, body lines are joined and
    carriage returns dropped.  Text before the first header is a contig without a name.
    """
    clean = F.regexp_replace(F.col(text_col), "\r", "")
    # a sentinel newline puts every header after a newline, so one split finds all records
    records = F.split(F.concat(F.lit("\n"), clean), "\n>")
    rows = texts.select(*keep, F.posexplode(records).alias("_i", "_record"))
    leading = F.col("_i") == 0
    header = F.regexp_extract("_record", "^([^\n]*)", 1)
    body = F.when(leading, F.col("_record")).otherwise(F.regexp_replace("_record", "^[^\n]*", ""))
    seq = F.regexp_replace(body, "\n", "")
    # position 0 is the text before the first header: usually nothing at all
    parsed = rows.select(*keep, "_i", F.when(~leading, header).alias("name"), seq.alias("seq"), leading.alias("_lead"))
    return parsed.where(~(F.col("_lead") & (F.length("seq") == 0))).select(
        *keep, F.greatest(F.col("_i") - 1, F.lit(-1)).cast("long").alias("ord"), "name", "seq")


def read_fasta(spark, paths) -> DataFrame:
    """``path, ord, name, seq`` with one row per contig; each file is one genome and one input record.

    ``ord`` is -1 for text before the first header and counts the headers from 0.
    """
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_texts(texts)


_PIECES = "path string, block long, head long, part long, name string, seq string"


def _cut_records(piece):
    """Lines in file order to pieces of records: ``head`` counts the headers of the block, 0 being what goes on from the block before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head, part, name, held, size, out, filled = None, 0, 0, None, [], 0, [], 0

        def flush():
            nonlocal held, size, part, name, filled
            if held or name is not None:
                out.append((*place, head, part, name, "".join(held)))
                filled += size + 1
                held, size, part, name = [], 0, part + 1, None

        def rows():
            nonlocal out, filled
            columns = list(zip(*out))
            out, filled = [], 0
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["path", "block", "head", "part", "name", "seq"])

        for batch in batches:
            for at, line in zip(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()), batch.column("value").to_pylist()):
                if at != place:
                    if place:
                        flush()
                    place, head, part = at, 0, 0
                line = line.replace("\r", "")
                if line.startswith(">"):
                    flush()
                    head, name = head + 1, line[1:]
                elif line:
                    held.append(line)
                    size += len(line)
                    if size >= piece:
                        flush()
            if filled > 1 << 20:
                yield rows()
        if place:
            flush()
        if out:
            yield rows()
    return run


def _numbered(spark, paths, piece):
    """``path, ord, block, part, name, seq``: pieces of records with the number of their record in its file."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = cut_lineage(lines.mapInArrow(_cut_records(piece), _PIECES))
    blocks = pieces.groupBy("path", "block").agg(F.max("head").alias("heads"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("before"))
    return pieces.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("head") - 1).alias("ord"), "block", "part", "name", "seq")


def read_large_fasta(spark, paths, piece=PIECE) -> DataFrame:
    """The rows of ``read_fasta`` for files that are themselves large: a file is read in byte ranges, so it is many tasks and never one value.

    A record that crosses ranges is put together from its pieces.  Ranges have the size that ``spark.sql.files.maxPartitionBytes`` says.
    """
    numbered = _numbered(spark, paths, piece)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "seq"))), lambda x: x["seq"]), "")
    return numbered.groupBy("path", "ord").agg(F.max("name").alias("name"), whole.alias("seq"))


def read_fasta_pieces(spark, paths, k, piece=PIECE) -> DataFrame:
    """``path, ord, name, offset, seq``: records in pieces that overlap by ``k - 1`` bases, so that each word of ``k`` is in exactly one.

    No record is ever one value.  Only the first bases of the pieces are put in order, not the pieces.
    """
    numbered = cut_lineage(_numbered(spark, paths, piece).where("seq <> '' or name is not null"))
    along = Window.partitionBy("path", "ord").orderBy("block", "part")
    ahead = F.array_join(F.collect_list("head").over(along.rowsBetween(1, max(1, k - 1))), "") if k > 1 else F.lit("")
    light = numbered.select("path", "ord", "block", "part", "name", F.length("seq").cast("long").alias("n"), F.substring("seq", 1, k - 1).alias("head"))
    names = light.groupBy("path", "ord").agg(F.max("name").alias("name"))
    placed = light.where("n > 0").select("path", "ord", "block", "part", F.substring(ahead, 1, k - 1).alias("halo"), (F.sum("n").over(along) - F.col("n")).alias("offset"))
    return numbered.drop("name").join(placed, ["path", "ord", "block", "part"]).join(names, ["path", "ord"]).select(
        "path", "ord", "name", "offset", F.concat("seq", "halo").alias("seq"))


def filter_short(contigs: DataFrame, min_length=DEFAULT_MIN_CONTIG) -> DataFrame:
    """Drop contigs below ``min_length`` raw characters; applied before validation."""
    return contigs.where(F.length("seq") >= min_length)


def validate(contigs: DataFrame, strict=True) -> DataFrame:
    """Decode sequences and add ``valid``.

    ``strict`` empties a contig with any character outside ``ACGTUN``; otherwise such characters become N.
    """
    valid = Q.is_valid("seq")
    decoded = Q.decode("seq")
    return contigs.withColumn("valid", valid).withColumn("seq", F.when(valid, decoded).otherwise(F.lit("")) if strict else decoded)


def genome_name(path):
    """File name without folders; ``GCF_``/``GCA_`` names are cut to their accession."""
    base = F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/\\\\]*)$", 1)
    accession = F.regexp_extract(base, "^(GC[FA]_.[^_]*)_", 1)
    return F.when(accession != "", accession).otherwise(base)


def as_genomes(contigs: DataFrame, min_length=DEFAULT_MIN_CONTIG, strict=True) -> DataFrame:
    """Contigs ready for signatures: filtered, validated, with ``genome_id`` named after the file."""
    return validate(filter_short(contigs, min_length), strict).withColumn("genome_id", genome_name("path"))


def write_fasta(contigs: DataFrame, path):
    """One record per contig, the sequence on one line."""
    contigs.select(Q.fasta_record(F.coalesce("name", F.lit("")), "seq")).write.mode("overwrite").text(path)


def write_fastq(contigs: DataFrame, path, quality=None):
    contigs.select(Q.fastq_record(F.coalesce("name", F.lit("")), "seq", quality)).write.mode("overwrite").text(path)


def contig_offsets(contigs: DataFrame, chunk=1 << 16) -> DataFrame:
    """``…, offset``: where each contig starts in the concatenation of its genome's contigs.

    Joined sequences are addressed by offset instead of being built as one value.  Running lengths are taken per chunk of
    ``ord`` and completed with the sums of the chunks before, so a genome of any size is spread over many tasks.
    """
    chunked = contigs.withColumn("_chunk", F.floor(F.col("ord") / chunk))
    length = F.length("seq").cast("long")
    before = Window.orderBy("_chunk").partitionBy("genome_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunked.groupBy("genome_id", "_chunk").agg(F.sum(length).alias("_n"))
    bases = bases.select("genome_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("genome_id", "_chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("_inside", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    return placed.join(bases, ["genome_id", "_chunk"]).withColumn("offset", F.col("_base") + F.col("_inside")).drop("_chunk", "_base", "_inside")
