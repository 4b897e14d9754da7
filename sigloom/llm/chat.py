"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation as prompt, and two masked completions.

Everything is a Column expression over arrays of turns; one pair is one row.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import pick

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role + middle + text + close + after``; ``guard`` in a text is written as ``guarded``, so no text can fake a turn."""
    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>"
    after: str = "\n"
    guard: str = "<|"
    guarded: str = "< |"
    trained: str = "assistant"

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.middle))

    def turn(self, t: Column) -> Column:
        return F.concat(self.header(t["role"]), t["text"], F.lit(self.close + self.after))


def turns_of(rows: DataFrame, key: str, order: str = "turn") -> DataFrame:
    """``key, turns``: the turns of each conversation in order; one conversation is one value.

    Rows are ordered by turn, then role and text; a null turn comes first, a null role or text counts as empty.  Rows without a key
    belong to no conversation.
    """
    turn = F.struct(F.col(order), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many leading turns agree in role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _completion(rest: Column, moved: Column, template: Template) -> tuple[Column, Column]:
    """The text of the remaining turns, and its trained spans ``start, end`` in code points: the text and closing mark of each trained turn."""
    header = F.length(F.lit(template.open + template.middle))
    text = F.array_join(F.transform(rest, lambda t, i: F.concat(
        F.when(moved & (i == 0), F.lit("")).otherwise(template.header(t["role"])), t["text"], F.lit(template.close + template.after))), "")
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, t):
        start = acc["at"] + header + F.length(t["role"])
        end = start + F.length(t["text"]) + len(template.close)
        return F.struct((end + len(template.after)).alias("at"), F.when(
            t["role"] == template.trained, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    begin = F.when(moved, -(header + F.length(F.get(rest, 0)["role"]))).otherwise(0).cast("int")
    spans = F.aggregate(rest, F.struct(begin.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])
    return text, spans


def format_pairs(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """``pairs`` (``pair_id, chosen, rejected``, turns as arrays of role and text) as
    ``pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans``.

    Where both sides go on with the same role its header closes the prompt, so each completion begins with content.  A null side counts
    as no turns.  Sides that are equal give two empty completions without spans; sides that share nothing give an empty prompt, or the
    header alone.
    """
    none = F.array().cast(TURNS)

    def clean(turns):
        return F.transform(F.coalesce(turns.cast(TURNS), none), lambda t: F.struct(
            F.replace(F.coalesce(t["role"], F.lit("")), F.lit(template.guard), F.lit(template.guarded)).alias("role"),
            F.replace(F.coalesce(t["text"], F.lit("")), F.lit(template.guard), F.lit(template.guarded)).alias("text")))

    at = pick(pairs, pair_id="pair_id", chosen="chosen", rejected="rejected")
    at = at.select("pair_id", clean(F.col("chosen")).alias("chosen"), clean(F.col("rejected")).alias("rejected"))
    at = at.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = [F.slice(side, F.col("n_common") + 1, F.size(side)).alias(f"{side}_rest") for side in ("chosen", "rejected")]
    at = at.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("common"), *rest)
    at = at.withColumn("moved", F.coalesce(F.get("chosen_rest", F.lit(0))["role"] == F.get("rejected_rest", F.lit(0))["role"], F.lit(False)))
    prompt = F.concat(F.array_join(F.transform("common", template.turn), ""),
                      F.when(F.col("moved"), template.header(F.get("chosen_rest", F.lit(0))["role"])).otherwise(F.lit("")))
    (chosen, chosen_spans), (rejected, rejected_spans) = (_completion(F.col(f"{side}_rest"), F.col("moved"), template) for side in ("chosen", "rejected"))
    return at.select("pair_id", "n_common", prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"),
                     chosen_spans.alias("chosen_spans"), rejected_spans.alias("rejected_spans"))


def stale_answer_pairs(conversations: DataFrame, key: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """Pairs from plain conversations: chosen ends with the last answer, rejected gives the answer before it (or nothing) again.

    A conversation without an answer is its own counterpart.
    """
    rows = pick(conversations, **{"pair_id": key, "turn": "turn", "role": "role", "text": "text"})
    at = turns_of(rows, "pair_id")
    answers = F.filter("turns", lambda t: t["role"] == trained)
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == trained), F.lit(True)).cast("int") + 1
    at = at.withColumns({"answers": answers, "last": last}).withColumn("stale", F.coalesce(F.get("answers", F.size("answers") - 2)["text"], F.lit("")))
    ends = F.size("answers") > 0
    chosen = F.when(ends, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns"))
    rejected = F.when(ends, F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit(trained).alias("role"), F.col("stale").alias("text"))))) \
        .otherwise(F.col("turns"))
    return at.select("pair_id", chosen.alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
