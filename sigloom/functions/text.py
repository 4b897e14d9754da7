"""Text expressions: paths, positions and number formatting."""

from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
DIGITS = 8  # digit budget of a printed signature value
# ----------------------------------------------------------------------------------------------


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def basename(path):
    return F.regexp_extract(_col(path), "([^/]*)$", 1)


def dirname(path):
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def join_text(parts, separator):
    return F.array_join(_col(parts), separator)


def split_text(text, separator):
    """Pieces between exact occurrences of ``separator``."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in separator)
    return F.split(_col(text), quoted)


def find_char(text, char):
    """0-based position of the first ``char``; the length of the text when there is none."""
    text = _col(text)
    at = F.instr(text, F.lit(char))
    return F.when(at > 0, at - 1).otherwise(F.length(text)).cast("int")


find_text = find_char


def _next(text, inverse_class):
    return F.length(F.regexp_extract(_col(text), f"^([^{inverse_class}]*)", 1)).cast("int")


def next_space(text):
    return _next(text, "\\s")


def next_upper(text):
    return _next(text, "A-Z")


def next_digit(text):
    return _next(text, "0-9")


def next_word_separator(text):
    return _next(text, " _.:\\-")


def number_text(value):
    """About seven significant digits: fixed point below ``10^8`` (six decimals under ten), exponent form beyond
    ``10^8`` and under ``10^-7``, and a bare ``0`` for zero.  Decimal halves round up."""
    value = _col(value).cast("double")
    magnitude = F.log10(F.abs(value))
    fixed = F.when(magnitude < 1, F.format_string("%.6f", value))
    for whole in range(1, DIGITS):
        fixed = fixed.when(magnitude < whole + 1, F.format_string(f"%.{max(DIGITS - 2 - whole, 0)}f", value))
    exponent = F.format_string(f"%.{DIGITS - 2}e", value)
    return F.when(value == 0, F.lit("0")).when((magnitude >= DIGITS) | (magnitude < 1 - DIGITS), exponent).otherwise(fixed)


def away_from_half(x):
    """Whether a double is clearly nearer to one millionth than to the next (and small enough to tell): then its nearest millionth needs no decimal text."""
    at = _col(x) * 1e6
    return (F.abs(at) < 1e9) & (F.abs(at - F.floor(at) - 0.5) > 1e-3)
