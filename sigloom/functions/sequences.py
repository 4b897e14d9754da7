"""Sequence expressions.  Everything here is a Column expression and stays inside code generation."""

from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
NUCLEOTIDES = "ACGT"
VALID_PATTERN = "^[ACGTUNacgtun]*$"
# standard genetic code, codons in TCAG order; a stop reads like an unknown codon
GENETIC_CODE = "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# ----------------------------------------------------------------------------------------------


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def slice_text(seq, start, length):
    """``length`` characters from the 1-based ``start`` of an ASCII sequence.

    Slicing the bytes is constant-time in ``start``; ``substring`` on text has to walk there first, which turns
    windowing a chromosome into quadratic work.
    """
    return F.substring(_col(seq).cast("binary"), start, length).cast("string")


def is_valid(seq):
    return _col(seq).rlike(VALID_PATTERN)


def decode(seq):
    """Upper-case ``ACGTN``: U reads as T and anything unknown as N.  Masking precedes case folding."""
    return F.upper(F.regexp_replace(F.translate(_col(seq), "Uu", "Tt"), "[^ACGTacgt]", "N"))


def compact(seq):
    """Upper-case ``ACGT`` with everything else removed."""
    return F.upper(F.regexp_replace(_col(seq), "[^ACGTacgt]+", ""))


def complement(seq):
    return F.translate(_col(seq), "ACGT", "TGCA")


def reverse_complement(seq):
    return F.reverse(complement(seq))


def subsequence(seq, begin, length):
    """``length`` bases from the 0-based ``begin``, clipped at the end of the sequence."""
    return slice_text(seq, F.lit(begin) + 1, F.lit(length))


def _codon_map():
    bases = "TCAG"
    codons = [a + b + c for a in bases for b in bases for c in bases]
    return dict(zip(codons, GENETIC_CODE))


def translate_codons(seq):
    """Amino acids of the complete codons from position 0; stops and codons with an N read as ``X``."""
    seq = _col(seq)
    table = F.create_map(*[F.lit(x) for pair in _codon_map().items() for x in pair])
    starts = F.when(F.length(seq) >= 3, F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))).otherwise(F.array())
    letters = F.transform(starts, lambda i: F.coalesce(F.try_element_at(table, slice_text(seq, i, F.lit(3))), F.lit("X")))
    return F.array_join(letters, "")


def wildcard_pattern(pattern):
    """Regular expression for a base pattern where N on either side matches anything."""
    return "".join("." if base == "N" else f"[{base}N]" for base in pattern.upper())


def find_from(seq, pattern, start=0):
    """0-based position of the first match at or after ``start``; the sequence length when there is none."""
    seq = _col(seq)
    tail = slice_text(seq, F.lit(start) + 1, F.length(seq))
    if "N" in pattern.upper():
        at = F.regexp_instr(tail, F.lit(wildcard_pattern(pattern)))
    else:
        # plain search when the data holds no wildcard, a regular expression only for the rows that do
        at = F.when(F.contains(tail, F.lit("N")), F.regexp_instr(tail, F.lit(wildcard_pattern(pattern)))).otherwise(
            F.locate(pattern, tail))
    return F.when(at > 0, at - 1 + F.lit(start)).otherwise(F.length(seq))


def cut_between(seq, opening, closing, max_length=None, require_begin=True, require_end=True, overlap=False):
    """All stretches from an ``opening`` marker through the next ``closing`` marker.

    Without ``require_begin`` a stretch may begin with the sequence, or right behind the one before; without ``require_end`` it may run to the end of the
    sequence.  A stretch longer than ``max_length`` is left out when both markers are required; otherwise it keeps
    the part at the marker that is: the front when the end is open, the tail when only the beginning is.  With ``overlap``
    every opening marker begins a stretch of its own.
    """
    first = wildcard_pattern(opening) if require_begin else ""
    last = wildcard_pattern(closing) if require_end else f"(?:{wildcard_pattern(closing)}|$)"
    body = f"{first}.*?{last}" if require_begin else f".*?{last}"
    found = F.regexp_extract_all(_col(seq), F.lit(f"(?=({body}))" if overlap else f"({body})"), F.lit(1))
    found = F.filter(found, lambda s: s != "")
    if max_length is None:
        return found
    if require_begin and require_end:
        return F.filter(found, lambda s: F.length(s) <= max_length)
    if not require_end:
        return F.transform(found, lambda s: F.substring(s, F.lit(1), F.lit(max_length)))
    return F.transform(found, lambda s: F.substring(s, F.greatest(F.length(s) - max_length + 1, F.lit(1)), F.lit(max_length)))


def cut_between_both_strands(seq, opening, closing, max_length=None, **flags):
    """``cut_between`` on the forward strand followed by the hits on the reverse strand, read forward."""
    forward = cut_between(seq, opening, closing, max_length, **flags)
    return F.concat(forward, cut_between(reverse_complement(seq), opening, closing, max_length, **flags))


def _chars(seq):
    return F.split(seq, "")


def nucleotide_identity(a, b):
    """Share of equal bases over the common length."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(
        F.zip_with(_chars(slice_text(a, F.lit(1), n)), _chars(slice_text(b, F.lit(1), n)), lambda x, y: (x == y).cast("long")),
        F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long")))
    return F.try_divide(F.when(n > 0, same.cast("double")), n.cast("double"))


def amino_acid_identity(a, b):
    return nucleotide_identity(translate_codons(a), translate_codons(b))


def gc_count(seq):
    return F.length(F.regexp_replace(_col(seq), "[^CG]", ""))


def pack_two_bit(seq):
    """Four bases per byte as hexadecimal text, first base in the high bits, zero padded on the right."""
    digits = F.translate(_col(seq), "ACGT", "0123")
    padded = F.rpad(digits, (F.ceil(F.length(digits) / 4) * 4).cast("int"), F.lit("0"))
    starts = F.when(F.length(padded) > 0, F.sequence(F.lit(1), F.length(padded), F.lit(4))).otherwise(F.array())
    pairs = F.transform(starts, lambda i: F.lpad(F.conv(slice_text(padded, i, F.lit(4)), 4, 16), 2, "0"))
    return F.array_join(pairs, "")


def fasta_record(name, seq):
    return F.concat(F.lit(">"), _col(name), F.lit("\n"), _col(seq))


def fastq_record(name, seq, quality=None):
    """Four-line record; without qualities every base gets Phred 20."""
    seq = _col(seq)
    q = F.repeat(F.lit(chr(ord("!") + 20)), F.length(seq)) if quality is None else _col(quality)
    return F.concat(F.lit("@"), _col(name), F.lit("\n"), seq, F.lit("\n+\n"), q)


def min_quality(quality):
    """Smallest Phred score of a quality string."""
    codes = F.transform(F.split(_col(quality), ""), lambda c: F.ascii(c) - ord("!"))
    return F.array_min(codes)
