"""Quality rules: counts per text, and lines that too many documents of one host repeat."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import LOWER, SPACE, UPPER, Carried, Written, pick, without_space, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate in a host when more than this many distinct texts, and more than this share of the host's texts, have it.
MAX_TEXTS, MAX_SHARE_PERCENT = 20, 5
#: A document is depleted when less than this share of its word characters is left, or fewer words than ``MIN_WORDS``.
MIN_LEFT_PERCENT = 30


def line_key(line: Column) -> Column:
    """A line as it is compared: no white space, A-Z in lower case, every digit a 0."""
    return F.translate(line, UPPER + "123456789" + SPACE, LOWER + "000000000")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(without_space(line)) > 0)


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of a text that is not null.

    Windows are hashed once per word and once per window.  Only texts whose window hashes repeat are sorted; the covered words are then
    the union of the intervals that start at a repeated window.
    """
    at = df.withColumn("q_text", text)
    at = at.withColumn("q_lines", _lines(F.col("q_text")))
    at = at.withColumn("q_hash", F.transform(words_of(F.col("q_text")), lambda w: F.xxhash64(w)))
    n = F.size("q_hash")
    at = at.withColumn("q_grams", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("q_hash"), i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("q_grams")) < F.size("q_grams")
    at = at.withColumn("q_sorted", F.when(repeats, F.sort_array(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("q_sorted")
    at = at.withColumn("q_found", F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(
        "q_found", F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total"), (i + WINDOW).alias("end")), lambda acc: acc["total"])
    # the always true test on a row number keeps a later filter on the counts above this step: pushed below it, the filter would
    # repeat the whole chain of expressions for each count it names
    out = at.withColumns({
        "n_words": F.when(F.monotonically_increasing_id() >= 0, n.cast("long")),
        "word_chars": F.length(without_space(F.col("q_text"))).cast("long"),
        "n_symbols": (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")})
    return out.drop("q_text", "q_lines", "q_hash", "q_grams", "q_sorted", "q_found")


def _distinct_lines(rows: DataFrame) -> DataFrame:
    """``host, text_hash, at, line, words, chars``: each line that is not blank, with its place among all lines of its text."""
    lines = rows.select("host", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "l")).filter(F.length(without_space(F.col("l"))) > 0)
    return lines.select("host", "text_hash", "at", F.xxhash64(line_key(F.col("l"))).alias("line"),
                        F.size(words_of(F.col("l"))).cast("long").alias("words"), F.length(without_space(F.col("l"))).cast("long").alias("chars"))


def frequent_lines(rows: DataFrame, max_texts=MAX_TEXTS, max_share_percent=MAX_SHARE_PERCENT) -> DataFrame:
    """``host, line``: the lines of a host that stand in too many of its distinct texts.  ``rows``: ``host, text, text_hash``.

    Copies of one text count once.  The text is part of the first key, so a line of every document is counted by all tasks, and only
    partial counts meet in one.
    """
    once = rows.select("host", "text_hash", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda line: F.xxhash64(line_key(line))))).alias("line"))
    counts = once.distinct().groupBy("host", "line").agg(F.count("*").alias("texts")).filter(F.col("texts") > max_texts)
    hosts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_texts"))
    return counts.join(hosts, "host").filter(F.col("texts") * 100 > F.col("host_texts") * max_share_percent).select("host", "line")


def removed(rows: DataFrame, written: Written, max_texts=MAX_TEXTS, max_share_percent=MAX_SHARE_PERCENT) -> DataFrame:
    """``host, text_hash, gone_words, gone_chars, gone_at`` of the texts that hold a frequent line; ``gone_at`` are the places of those lines, in order.

    The frequent lines are written first, so that the join with all lines knows their true size.
    """
    frequent = written.table(frequent_lines(rows, max_texts, max_share_percent))
    copies = rows.select("host", "text_hash", "text")
    # a line may stand in a text more than once, and a text in a host more than once: repeats of the text are divided out again
    hit = _distinct_lines(copies).join(frequent, ["host", "line"])
    per_text = hit.groupBy("host", "text_hash").agg(
        F.sum("words").alias("all_words"), F.sum("chars").alias("all_chars"), F.sort_array(F.collect_set("at")).alias("gone_at"))
    times = rows.groupBy("host", "text_hash").agg(F.count("*").alias("times"))
    return per_text.join(times, ["host", "text_hash"]).select(
        F.col("host").alias("r_host"), F.col("text_hash").alias("r_hash"), (F.col("all_words") / F.col("times")).cast("long").alias("gone_words"),
        (F.col("all_chars") / F.col("times")).cast("long").alias("gone_chars"), "gone_at")


def without_lines(text: Column, gone_at: Column) -> Column:
    """``text`` without the lines at the places ``gone_at``, in order; all of it where that is null.

    The lines between two places are taken as one slice, so the work grows with the text and not with lines times places.
    """
    def kept(lines):
        ends = F.concat(gone_at, F.array(F.size(lines)))
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
        return F.array_join(F.flatten(F.transform(ends, lambda end, i: F.slice(lines, begin(i) + 1, end - begin(i)))), "\n")

    return F.when(F.size(gone_at) > 0, F.transform(F.array(F.split(text, "\n", -1)), kept)[0]).otherwise(text)


def _verdict(counted: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left_words = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    left_chars = F.col("word_chars") - F.coalesce("gone_chars", F.lit(0))
    depleted = F.coalesce("gone_words", F.lit(0)) > 0
    depleted &= (left_words < MIN_WORDS) | (left_chars * 100 < F.col("word_chars") * MIN_LEFT_PERCENT)
    return counted.withColumns({"base_failed": base, "n_removed_words": F.coalesce("gone_words", F.lit(0)), "kept": ~base & ~depleted})


def _judged(frame: DataFrame, text: Column, host: Column) -> DataFrame:
    rows = frame.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    gone = removed(rows.withColumn("text_hash", F.xxhash64("text")), Written(frame.sparkSession))
    keyed = frame.withColumns({"q_host": F.coalesce(host.cast("string"), F.lit("")), "q_key": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    counted = with_counts(keyed, F.coalesce(text.cast("string"), F.lit("")))
    return _verdict(counted.join(gone, (F.col("q_host") == F.col("r_host")) & (F.col("q_key") == F.col("r_hash")), "left"))


def judge(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the five counts, ``base_failed``, ``n_removed_words`` and ``kept``.

    A null or empty text has no words and fails.  A null host counts as the empty host.  Rows that repeat get the same verdict.
    """
    narrow = pick(docs, doc_id=id_col, text=text_col, host=host_col)
    out = _judged(narrow, F.col("text"), F.col("host"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def keep_good(docs: DataFrame, text_col="text", host_col="source", chars_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; frequent lines are taken out of their texts, and ``chars_col`` gets the new number of code points.

    The rules are those of ``judge``.  A text without frequent lines stays as it is.
    """
    carried = Carried(docs)
    text = without_lines(carried.col(text_col).cast("string"), F.col("gone_at"))
    kept = _judged(carried.frame, carried.col(text_col), carried.col(host_col)).filter("kept").withColumn("q_clean", text)
    replaced = {text_col: F.col("q_clean")}
    if chars_col:
        hit = F.size("gone_at") > 0
        replaced[chars_col] = F.when(hit, F.length("q_clean").cast(docs.schema[chars_col].dataType)).otherwise(carried.col(chars_col))
    return carried.back(kept, **replaced)
