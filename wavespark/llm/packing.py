"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Permitted sequence lengths in tokens, and what a sequence costs besides its tokens, in tokens.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 16
#: Tokens that are packed together, about: enough that the last, half-empty bins of a bucket don't matter, and few
#: enough for one task.
BUCKET_TOKENS = 1 << 24

#: The query's vocabulary, and how text is cut up for it (a fixed value of that vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORDS = "[^ \\t\\n\\x0B\\f\\r]+"


def best_fit(sizes: Sequence[int], capacities: Sequence[int], opened: int | None = None, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Packs sizes in the order given: each goes to the open bin that it fills best, else to a new one. Of bins with equal
    room the one filled last is taken.

    A new bin has the capacity opened or, if that is too small, the smallest that takes the size. Without opened it has the
    one of least cost a token, capacity and overhead over what it would hold if the largest sizes still to come that fit
    were put into it one after another; of equals the larger.

    Returns each size's bin, each size's offset in its bin, and the tokens in each bin. The rooms of open bins, and the
    sizes still to come, are bits of numbers, so the nearest to a room or size is found without a search.
    """
    bins, offsets, used = [], [], []
    rooms, waiting = 0, {}
    left, ahead = Counter(sizes), 0
    for size in left:
        ahead |= 1 << size
    below = [(1 << (n + 1)) - 1 for n in range(capacities[-1] + 1)] if opened is None else []

    def held(room: int) -> int:
        """How much of the room the sizes to come would take, the largest first; those of 0 tokens don't count."""
        taken, top = 0, room
        while top > 0 and (found := ahead & below[top] & ~1):
            size = found.bit_length() - 1
            taken += min(left[size], (room - taken) // size) * size
            top = min(size - 1, room - taken)
        return taken

    for size in sizes:
        left[size] -= 1
        if not left[size]:
            ahead ^= 1 << size
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            stack = waiting[room]
            k = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            k, fits = len(used), [c for c in capacities if c >= size]
            if opened is None:
                room = min(fits, key=lambda c: ((c + overhead) / max(size + held(c - size), 1), -c))
            else:
                room = next(c for c in fits if c >= opened or c == fits[-1])
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += size
        if room > size:
            stack = waiting.setdefault(room - size, [])
            if not stack:
                rooms |= 1 << (room - size)
            stack.append(k)
    return bins, offsets, used


def pack_bucket(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int], list[int]]:
    """Packs sizes (falling; none above the largest capacity) with the capacities optimised jointly.

    Each opening chooses the capacity of least cost (see best_fit); then each bin is downsized to the smallest capacity
    that holds its contents. As a bound, one capacity for all openings is tried as well, each of them. Of these packings
    the one of least cost stays, the sum of capacity and overhead over its bins; of equals, the first. Returns bins,
    offsets, used, and capacity by bin.
    """
    best = None
    for opened in (None, *capacities):
        bins, offsets, used = best_fit(sizes, capacities, opened, overhead)
        sized = [next(c for c in capacities if c >= n) for n in used]
        cost = sum(sized) + overhead * len(sized)
        if best is None or cost < best[0]:
            best = cost, bins, offsets, used, sized
    return best[1:]


def _packed(group: pd.DataFrame, capacities: Sequence[int], overhead: int) -> pd.DataFrame:
    group = group.sort_values(["tokens", "id", "piece", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    bins, offsets, used, sized = pack_bucket(group["tokens"].tolist(), capacities, overhead)
    bucket = int(group["bucket"].iloc[0])
    return pd.DataFrame({
        "id": group["id"], "piece": group["piece"], "start": group["start"], "tokens": group["tokens"],
        "bin_id": [bucket << 32 | b for b in bins], "bin_offset": offsets, "bin_used": [used[b] for b in bins], "bin_capacity": [sized[b] for b in bins],
    })


def word_tokens(text_col: str = "text") -> Column:
    """Words between white space, and one token for the end of the document."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)) + 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """Packs documents into sequences of the permitted lengths, so that padding and the number of sequences cost least.

    tokens: length of a row in tokens; word_tokens() unless given. Nothing is cut off: a document longer than the largest
    capacity becomes pieces of that length and a rest. Returns a row for each piece: id_col, piece (0, 1, ...), start
    (its first token in the document), tokens, bin_id, bin_offset, bin_used and bin_capacity.

    The lengths are written once. Pieces are then dealt by hash to buckets of about bucket_tokens tokens, as many as the
    total needs, and each is packed by itself: no bucket grows with the input, and only its last bins are worse than
    those of one large packing.

    Defined results: null or negative lengths count 0, and rows of 0 tokens take part (they are pieces of 0 tokens).
    Repeated rows are packed as often as they come, dealt to buckets by row, so a hot id fills no bucket. Other columns
    of docs are ignored. An empty table gives an empty result.
    """
    capacities = tuple(sorted(set(capacities)))
    length = word_tokens() if tokens is None else tokens
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length")))
    total = rows.agg(F.sum("length").alias("n"), F.count("*").alias("rows")).first()
    # A piece counts one token at least, so that no number of empty rows makes a bucket large.
    buckets = max(1, -(-((total["n"] or 0) + total["rows"]) // bucket_tokens))
    most = capacities[-1]
    last = F.greatest(F.ceil(F.col("length") / most) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = pieces.select(
        "id", "row", "piece", start.alias("start"), F.least(F.lit(most), F.col("length") - start).alias("tokens"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).alias("bucket"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, tokens long, bin_id long, bin_offset long, bin_used long, bin_capacity long"
    packed = pieces.groupBy("bucket").applyInPandas(lambda group: _packed(group, capacities, overhead), schema)
    return packed.withColumnRenamed("id", id_col)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoding = encoding_of(path, pattern)
    for batch in batches:
        ids = [encoding.encode_ordinary(x.as_py() or "") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])


def _counted(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoding = encoding_of(path, pattern)
    for batch in batches:
        n = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n"])


@cache
def encoding_of(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenized(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids, the token numbers of the whole text, in one pass. path: a vocabulary of byte pairs and their ranks, a
    file that every executor can read; pattern: how text is cut up before pairs are merged.

    Defined results: a null or empty text has no tokens. Marks like those of special tokens are ordinary text. Rows are
    returned as often as they come, an empty table gives none. Other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: _encoded(batches, path, pattern), f"id {slim.dtypes[0][1]}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and n, how many tokens tokenized() gives the text."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: _counted(batches, path, pattern), f"id {slim.dtypes[0][1]}, n long").withColumnRenamed("id", id_col)


def sequences(tokens: DataFrame, packed: DataFrame, end: int, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: bin_id, bin_capacity, ids (the tokens of the bin's pieces one after another, each
    document's last piece with the token end after it) and ends (where each piece ends in ids, for masks that keep
    documents apart).

    tokens: one row (id_col, ids) for each document; packed: what pack() gives for lengths of one more than size(ids).
    A document's tokens are joined to its pieces, and a bin's pieces gathered, which are bin_capacity tokens at most and
    as many empty ones as there are. Documents without a row in tokens count as empty. An empty table gives none.
    """
    whole = F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end)))
    pieces = packed.join(tokens, id_col, "left").select("bin_id", "bin_capacity", "bin_offset", "tokens", F.slice(whole, (F.col("start") + 1).cast("int"), F.col("tokens").cast("int")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("bin_offset", "tokens", "part")))
    found = pieces.groupBy("bin_id", "bin_capacity").agg(parts.alias("parts"))
    ends = F.transform("parts", lambda p: p["bin_offset"] + p["tokens"])
    return found.select("bin_id", "bin_capacity", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"), ends.alias("ends"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the documents by their tokens, with one more for the end of each."""
    return pack(token_counts(table(spark, sf_dir, "documents")), tokens=F.col("n") + 1)
