"""Preference formatting: the turns that two conversations share become one prompt, the rest paired, masked completions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the rendering of a turn: before and after the role, and after the text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Whose turns a model is trained on.
TRAINED = "assistant"
#: Label of a token that no loss is taken on.
IGNORED = -100


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def _mask(turns: Column) -> Column:
    """start:end of the trained stretches of the rendered turns, in code points, end exclusive, joined by commas: text and
    end mark of each trained turn, not its head."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        body = done["at"] + F.length(turn["role"]) + len(OPEN + CLOSE)
        end = body + F.length(turn["text"]) + len(END)
        span = F.array(F.concat_ws(":", body.cast("string"), end.cast("string")))
        spans = F.when(turn["role"] == TRAINED, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: F.array_join(done["spans"], ","))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Formats pairs of conversations for preference training.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id. Returns for each pair, with both ids:
    prompt_turns (length of the longest common prefix, turns being equal in role and text), prompt (these turns,
    rendered once), chosen and rejected (what follows in each conversation), and chosen_mask and rejected_mask (the
    stretches of the completions that the loss is for, see _mask).

    A conversation is put together once, whatever the number of its pairs. It is the unit of the output and so of the
    work: one task holds a conversation's text, as its result row must. A conversation in very many pairs is a hot key of
    the joins, which reach both sides by plain exchanges that adaptive execution splits.

    Defined results: turns are ordered by turn, then role and text. Null roles and texts are empty. Turns without a
    conv_id are left out. A conversation that is missing, or a null id, has null completion and mask, and the pair's
    prompt is empty. Conversations that are equal leave empty completions. A conversation that begins with the whole
    other one leaves that one an empty completion. Repeated turn rows count as turns of their own, repeated pairs as
    pairs. Empty tables give an empty result.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    whole = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.struct("turn", text("role"), text("text"))).alias("turns"))
    whole = whole.select(F.xxhash64("conv_id").alias("key"), "conv_id", F.array_sort("turns").alias("turns"))

    def side(name: str) -> DataFrame:
        return whole.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"_{name}"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias(f"_{name}_key"))

    # Keys are rewritten so that the conversations, too, come to the join by an exchange of its own.
    out = pairs.select("pair_id", "chosen_id", "rejected_id")
    for name in ("chosen", "rejected"):
        key = F.coalesce(F.concat(F.lit("c"), F.col(f"{name}_id").cast("string")), F.concat(F.lit("-"), F.coalesce(F.col("pair_id").cast("string"), F.lit(""))))
        out = out.withColumn(f"_{name}_key", key).join(side(name).drop(f"{name}_id"), f"_{name}_key", "left")
    same = F.zip_with("_chosen", "_rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    shared = F.coalesce(F.when(first > 0, first - 1).otherwise(F.size(same)), F.lit(0)).cast("int")
    out = out.withColumn("prompt_turns", F.when(F.col("_chosen").isNull() | F.col("_rejected").isNull(), 0).otherwise(shared))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    prompt = F.coalesce(_rendered(F.slice("_chosen", F.lit(1), F.col("prompt_turns"))), F.lit(""))
    return out.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", prompt.alias("prompt"),
        _rendered(rest("_chosen")).alias("chosen"), _rendered(rest("_rejected")).alias("rejected"),
        _mask(rest("_chosen")).alias("chosen_mask"), _mask(rest("_rejected")).alias("rejected_mask"),
    )


def _labelled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for batch in batches:
        columns = [batch.column(0), pa.array([tokenizer.encode(p.as_py() or "", add_special_tokens=False).ids for p in batch.column(1)], pa.list_(pa.int32()))]
        for k in (2, 3):
            ids, labels = [], []
            for text, mask in zip(batch.column(k), batch.column(k + 2), strict=True):
                found = tokenizer.encode(text.as_py() or "", add_special_tokens=False)
                spans = [tuple(map(int, s.split(":"))) for s in (mask.as_py() or "").split(",") if s]
                inside = [any(s <= a and b <= e for s, e in spans) for a, b in found.offsets]
                ids.append(found.ids)
                labels.append([t if x else IGNORED for t, x in zip(found.ids, inside, strict=True)])
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["pair_id", "prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"])


def tokenize_preferences(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token ids of prompt and completions of format_preferences, and labels of the completions: the id where the token
    lies within the mask, else -100. tokenizer_path: a tokenizer file that every executor can read.

    Defined results: a null completion has no ids and no labels, as has an empty one; a token that lies only partly within
    the mask is not trained on. Texts of any length are encoded whole. Rows are returned as often as they come; an empty
    table gives none; other columns are left out."""
    slim = formatted.select("pair_id", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    lists = ", ".join(f"{c} array<int>" for c in ("prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"))
    return slim.mapInArrow(lambda batches: _labelled(batches, tokenizer_path), f"pair_id {slim.dtypes[0][1]}, {lists}")


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs conversation 2k, as the chosen one, with 2k + 1, as the rejected one; one may be missing, and its id is null
    then. Turns with a null conv_id are left out; repeated turns make no further pairs; an empty table gives none. Only ids
    are read, so texts may be of any length and other columns have any names."""
    even = F.pmod("conv_id", F.lit(2)) == 0
    pair = F.floor((F.col("conv_id") - F.pmod("conv_id", F.lit(2))) / 2).cast("long")
    return turns.where("conv_id IS NOT NULL").groupBy(pair.alias("pair_id")).agg(
        F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id")
    )


def with_swapped_answers(turns: DataFrame) -> DataFrame:
    """Each conversation c twice: as 2c with its own turns, and as 2c + 1 with the text of its last answer (the last turn
    of a trained role) replaced by that of its neighbour's, conversations 2k and 2k + 1 being neighbours; what came after
    that answer is left off. A conversation without an answer, or whose neighbour has none, is only there as 2c.

    So own_pairs() sets each conversation against itself with a reply that was given to something else.
    Of answers of the same turn number the one of the largest text counts. One row a conversation is joined to its turns.
    Turns with a null conv_id or, in 2c + 1, turn are left out; a null text is the empty text. Empty tables give none.
    """
    turns = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    answer = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    last = turns.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(answer).alias("own"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("own.text").alias("other"))
    swap = last.select("conv_id", F.col("own.turn").alias("at")).join(other, "conv_id")
    before = turns.join(swap, "conv_id").where("turn < at").select((2 * F.col("conv_id") + 1).alias("conv_id"), "turn", "role", "text")
    reply = swap.select((2 * F.col("conv_id") + 1).alias("conv_id"), F.col("at").alias("turn"), F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    return turns.withColumn("conv_id", 2 * F.col("conv_id")).unionByName(before).unionByName(reply)


def own_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation c of turns: 2c as the chosen one, 2c + 1 as the rejected one, as with_swapped_answers
    numbers them; the latter may be missing there."""
    ids = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id")).distinct()
    return ids.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(with_swapped_answers(turns), own_pairs(turns))


OP7_SQL = f"""
WITH given AS (SELECT conv_id::BIGINT AS conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS k
  FROM given WHERE role = '{TRAINED}' AND turn IS NOT NULL
), swap AS (SELECT a.conv_id, a.turn AS place, b.text AS other FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1) WHERE a.k = 1 AND b.k = 1),
doubled AS (
  SELECT 2 * conv_id AS conv_id, turn, role, text FROM given
  UNION ALL SELECT 2 * g.conv_id + 1, turn, role, text FROM given g JOIN swap s ON s.conv_id = g.conv_id AND turn < place
  UNION ALL SELECT 2 * conv_id + 1, place, '{TRAINED}', other FROM swap
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM doubled
), pairs AS (SELECT DISTINCT conv_id AS pair_id, 2 * conv_id AS chosen_id, 2 * conv_id + 1 AS rejected_id FROM given
), sizes AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY 1),
differ AS (
  SELECT p.pair_id, min(a.pos) AS pos FROM pairs p JOIN t a ON a.conv_id = p.chosen_id
  JOIN t b ON b.conv_id = p.rejected_id AND b.pos = a.pos WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1
), shared AS (
  SELECT p.*, CASE WHEN c.n IS NULL OR r.n IS NULL THEN 0 ELSE coalesce(d.pos - 1, least(c.n, r.n)) END AS prompt_turns
  FROM pairs p LEFT JOIN sizes c ON c.conv_id = p.chosen_id LEFT JOIN sizes r ON r.conv_id = p.rejected_id
  LEFT JOIN differ d USING (pair_id)
), turns AS (
  SELECT s.pair_id, t.conv_id, t.pos, t.role, t.pos > s.prompt_turns AS own,
         '{OPEN}' || t.role || '{CLOSE[:-1]}' || chr(10) || t.text || '{END[:-1]}' || chr(10) AS shown
  FROM shared s JOIN t ON t.conv_id // 2 = s.pair_id AND (t.conv_id = s.chosen_id OR t.conv_id = s.rejected_id)
), placed AS (
  SELECT *, sum(CASE WHEN own THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, conv_id ORDER BY pos) AS till FROM turns
), done AS (
  SELECT pair_id, conv_id, coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT own), '') AS prompt,
         coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE own), '') AS completion,
         coalesce(string_agg((till - length(shown) + length(role) + {len(OPEN + CLOSE)})::BIGINT || ':' || till::BIGINT, ',' ORDER BY pos)
                  FILTER (WHERE own AND role = '{TRAINED}'), '') AS mask
  FROM placed GROUP BY ALL
)
SELECT s.pair_id, s.chosen_id, s.rejected_id, s.prompt_turns::INTEGER AS prompt_turns, coalesce(c.prompt, '') AS prompt,
       c.completion AS chosen, r.completion AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM shared s LEFT JOIN done c ON c.pair_id = s.pair_id AND c.conv_id = s.chosen_id
LEFT JOIN done r ON r.pair_id = s.pair_id AND r.conv_id = s.rejected_id
"""
