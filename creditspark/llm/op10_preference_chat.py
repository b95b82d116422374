"""Operator 10 [native]: preference formatting of chat pairs.

Chosen and rejected conversations of a pair are compared turn by turn; their longest common turn
prefix is rendered once as the prompt, what follows on each side as a completion with a loss
mask. One aggregation gathers a pair's turns (a pair is one output row), everything else is
expressions over the two turn arrays; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<|{}|>\n", "<|end|>\n"


def _render(turn: F.Column) -> F.Column:
    opened = [F.lit(part) for part in TURN_OPEN.split("{}")]
    return F.concat(opened[0], turn["role"], opened[1], turn["text"], F.lit(TURN_CLOSE))


def _header_length(turn: F.Column) -> F.Column:
    return F.length(turn["role"]) + F.lit(len(TURN_OPEN) - 2)


def _mask(turns: F.Column) -> F.Column:
    """(start, length, train) spans, in characters, that tile the rendered turns: an assistant's
    text and its closing mark are trained on, headers and other roles aren't."""
    state = "struct<at: int, spans: array<struct<start: int, length: int, train: boolean>>>"
    empty = F.from_json(F.lit('{"at": 0, "spans": []}'), state)
    span = lambda start, length, train: F.struct(start.alias("start"), length.alias("length"), train.alias("train"))

    def add(acc, turn):
        whole = F.length(_render(turn))
        head = F.when(turn["role"] == "assistant", _header_length(turn)).otherwise(whole).cast("int")
        spans = F.array(span(acc["at"], head, F.lit(False)), span((acc["at"] + head).cast("int"), (whole - head).cast("int"), F.lit(True)))
        return F.struct((acc["at"] + whole).cast("int").alias("at"), F.concat(acc["spans"], F.filter(spans, lambda s: s["length"] > 0)).alias("spans"))

    return F.aggregate(turns, empty, add, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair id (``conv_id``) of two turn tables (conv_id, turn, role, text).

    Columns: conv_id, n_common (turns in the common prefix), prompt, chosen, rejected (rendered
    completions), chosen_mask, rejected_mask (spans tiling each completion), status (``pair``;
    ``identical`` when nothing differs; ``one_sided`` when a side has no turns at all).

    Turns are ordered by (turn, role, text), nulls first; a null role is ``user``, a null text empty;
    repeated turn rows count as further turns. Null conv_ids form one pair. When one side ends
    inside the other its completion is empty. Other columns are ignored; empty tables give none.
    """
    def side(df: DataFrame, name: int) -> DataFrame:
        return df.select("conv_id", F.lit(name).alias("side"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    both = side(chosen, 0).unionByName(side(rejected, 1))
    turn = F.struct("turn", "role", "text")
    gathered = both.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, turn))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, turn))).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.expr("filter(sequence(0, least(size(c), size(r))), i -> i = least(size(c), size(r)) or c[i].role <> r[i].role or c[i].text <> r[i].text)")
    found = gathered.withColumn("n_common", F.array_min(differs)).withColumn("_shorter", shorter)
    found = found.select(
        "conv_id", "n_common", F.size("c").alias("_nc"), F.size("r").alias("_nr"),
        F.expr("slice(c, 1, n_common)").alias("p"),
        F.expr("slice(c, n_common + 1, greatest(size(c) - n_common, 0))").alias("c"),
        F.expr("slice(r, n_common + 1, greatest(size(r) - n_common, 0))").alias("r"))
    text = lambda name: F.array_join(F.transform(name, _render), "")
    status = (F.when((F.col("_nc") == 0) | (F.col("_nr") == 0), "one_sided")
              .when((F.col("_nc") == F.col("n_common")) & (F.col("_nr") == F.col("n_common")), "identical").otherwise("pair"))
    return found.select("conv_id", "n_common", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
                        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"), status.alias("status"))
