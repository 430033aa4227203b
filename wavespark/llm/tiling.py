"""Benchmark decontamination by greedy string tiling, with running Karp-Rabin matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

#: Words of a seed, which is also the shortest tile, and the share of an item's words that tiles must cover.
SEED, COVERAGE = 5, 0.8
#: Bytes of benchmark text whose seeds go to every task at once; a larger benchmark is taken in blocks of so many.
BLOCK_BYTES = 16 << 20
#: Words of a document handled at a time when seeds are looked up.
CHUNK = 1 << 16
#: The first length that the matching looks for.
FIRST_LENGTH = 20

WORD = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def karp_rabin(tokens: list[int], length: int) -> list[int]:
    """Rolling hashes of all stretches of so many tokens."""
    if length > len(tokens):
        return []
    top = pow(_BASE, length - 1, _MOD)
    h = 0
    for t in tokens[:length]:
        h = (h * _BASE + t) % _MOD
    out = [h]
    for k in range(length, len(tokens)):
        h = ((h - tokens[k - length] * top) * _BASE + tokens[k]) % _MOD
        out.append(h)
    return out


def _stretches(marked: bytearray) -> Iterator[tuple[int, int]]:
    """The unmarked stretches."""
    at = 0
    for mark, run in groupby(marked):
        n = sum(1 for _ in run)
        if not mark:
            yield at, at + n
        at += n


def greedy_tiles(item: list[int], doc: list[int], least: int = SEED, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of at least least tokens, none overlapping another on either side.

    Running-Karp-Rabin greedy string tiling: for a falling search length, stretches of unmarked doc tokens are hashed,
    those of the item are looked up and extended, and matches are marked from the longest down. When a match is more
    than twice as long as the search length, the search starts over at its length, so that the longest comes first.
    Of equally long matches the one first in the item, then in the doc, wins.
    """
    in_item, in_doc = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(item)))
    while True:
        places: dict[int, list[int]] = {}
        for start, end in _stretches(in_doc):
            for k, h in enumerate(karp_rabin(doc[start:end], length)):
                places.setdefault(h, []).append(start + k)
        matches, longest = [], 0
        for start, end in _stretches(in_item):
            for k, h in enumerate(karp_rabin(item[start:end], length)):
                for d in places.get(h, ()):
                    p = start + k
                    if p > start and d > 0 and not in_doc[d - 1] and item[p - 1] == doc[d - 1]:
                        continue  # part of the match that begins a token earlier
                    n = 0
                    while p + n < end and d + n < len(doc) and not in_doc[d + n] and item[p + n] == doc[d + n]:
                        n += 1
                    if n >= length:
                        matches.append((n, p, d))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        heap = [(-n, p, d) for n, p, d in matches]
        heapify(heap)
        while heap:
            n, p, d = heappop(heap)
            n = -n
            if not any(in_item[p : p + n]) and not any(in_doc[d : d + n]):
                in_item[p : p + n] = in_doc[d : d + n] = b"\1" * n
                tiles.append((p, d, n))
                continue
            # What the marked tokens leave of the match waits its turn by its own length.
            at = 0
            while at < n:
                run = at
                while run < n and not in_item[p + run] and not in_doc[d + run]:
                    run += 1
                if run - at >= length:
                    heappush(heap, (at - run, p + at, d + at))
                at = run + 1
        if length <= least:
            return sorted(tiles)
        length = max(least, length // 2)


class Seeds:
    """The seeds of a block of items: sorted hashes of every stretch of SEED tokens, and where each lies."""

    def __init__(self, items: list[tuple[object, str | None]], least: int = SEED):
        self.least = least
        self.numbers: dict[str, int] = {}
        self.ids, self.items = [], []
        hashes, item_of, start_of = [], [], []
        for key, text in items:
            tokens = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            found = self.hashes_at(np.array(tokens, np.uint64), np.arange(max(0, len(tokens) - least + 1)))
            hashes.append(found)
            item_of.append(np.full(len(found), len(self.items)))
            start_of.append(np.arange(len(found)))
            self.ids.append(key)
            self.items.append(tokens)
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.zeros(0, np.int64)
        empty = [np.zeros(0, np.int64)]
        self.sorted = np.concatenate(hashes)[order] if hashes else np.zeros(0, np.uint64)
        self.item_of, self.start_of = np.concatenate(item_of or empty)[order], np.concatenate(start_of or empty)[order]

    def hashes_at(self, tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for j in range(self.least):
            out = (out ^ tokens[start + j]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def seeded(self, tokens: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each item that shares a seed: the starts of the shared seeds in the item, and in the document."""
        item, at, place = [], [], []
        for k in range(0, len(tokens), CHUNK):
            piece = tokens[k : k + CHUNK + self.least - 1]
            if len(piece) < self.least:
                continue
            known = piece != 0  # a seed has words of the benchmark alone
            full = known[: len(piece) - self.least + 1].copy()
            for j in range(1, self.least):
                full &= known[j : j + len(full)]
            start = np.flatnonzero(full)
            if not len(start):
                continue
            found = self.hashes_at(piece, start)
            low = np.searchsorted(self.sorted, found, "left")
            count = np.searchsorted(self.sorted, found, "right") - low
            hit = np.flatnonzero(count)
            if len(hit):
                n = count[hit]
                entry = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                item.append(self.item_of[entry])
                at.append(self.start_of[entry])
                place.append(np.repeat(start[hit], n) + k)
        if not item:
            return {}
        item, at, place = np.concatenate(item), np.concatenate(at), np.concatenate(place)
        order = np.argsort(item, kind="stable")
        keys, first = np.unique(item[order], return_index=True)
        return {int(k): (at[o], place[o]) for k, o in zip(keys, np.split(order, first[1:]), strict=True)}

    def matches(self, text: str | None, coverage: float) -> Iterator[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """Item id, its length, words covered and tiles, of each item that the text covers to that share."""
        found = words(text)
        tokens = np.fromiter(map(self.numbers.get, found, repeat(0)), np.uint64, len(found))
        for k, (at, place) in self.seeded(tokens).items():
            item = self.items[k]
            # Every tile is made of shared seeds: where none is, nothing can be covered. So items whose seeds reach too
            # few of their words are out, and only the parts of the document within seeds need matching.
            reach = np.zeros(len(item) + self.least, np.int64)
            for j in range(self.least):
                reach[at + j] = 1
            if reach.sum() < coverage * len(item):
                continue
            inside = np.zeros(len(tokens) + 1, bool)
            for j in range(self.least):
                inside[place + j] = True
            inside = inside[: len(tokens)]
            shown = np.flatnonzero(inside | np.r_[False, inside[:-1]])  # with one token between parts, to keep them apart
            doc = np.where(inside[shown], tokens[shown].astype(np.int64), -1).tolist()
            tiles = [(p, int(shown[d]), n) for p, d, n in greedy_tiles(item, doc, self.least)]
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                yield self.ids[k], len(item), covered, tiles


def _contaminated(batches: Iterator[pa.RecordBatch], seeds: Seeds, coverage: float, item_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, out = [], []
        for k, text in enumerate(batch.column(1)):
            for found in seeds.matches(text.as_py(), coverage):
                key.append(k)
                out.append(found)
        tiles = [[{"item_start": p, "doc_start": d, "words": n} for p, d, n in f[3]] for f in out]
        kind = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
        columns = [
            batch.column(0).take(pa.array(key, pa.int64())), pa.array([f[0] for f in out], item_kind), pa.array([f[1] for f in out], pa.int64()),
            pa.array([f[2] for f in out], pa.int64()), pa.array(tiles, kind),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "item_words", "covered", "tiles"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most so many bytes of text, one block on the driver at a time."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row.text.encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += n
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, least: int = SEED, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of documents and benchmark items whose words the document covers to the share coverage or more.

    Returns id_col, item_id, item_words, covered (words in tiles), coverage, and tiles: the non-overlapping stretches of
    at least least words found in both, in the order of the item, each with its place in item and document. Passages
    that were moved about, cut up or run into other text are found alike.

    Words are runs of letters, digits and underscores, lower-cased. Documents meet items by shared seeds of least words;
    an item can be left out only if the seeds can't cover enough of it, which loses nothing. The seeds of the benchmark
    go to the tasks as a sorted table made from at most block_bytes of its text; larger benchmarks take a pass over the
    documents for each block. Documents are read whole and never shuffled, so frequent passages meet in no task.

    Defined results: null texts, and items or documents of fewer than least words, are in no pair. Repeated rows of docs
    give repeated pairs, repeated items pairs of their own. Item ids are of any type, text too. Items with a null id are left out. Empty tables give none.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {slim.dtypes[0][1]}, item_id {dict(benchmark.dtypes)[item_col]}, item_words long, covered long, tiles array<struct<item_start:long,doc_start:long,words:long>>"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds(block, least))
        found = slim.mapInArrow(lambda batches, seeds=seeds: _contaminated(batches, seeds.value, coverage, kind), schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    share = F.col("covered") / F.col("item_words")
    return out.select(F.col("id").alias(id_col), "item_id", "item_words", "covered", share.alias("coverage"), "tiles")


def _clean(batches: Iterator[pa.RecordBatch], seeds: Seeds, coverage: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not any(True for _ in seeds.matches(x.as_py(), coverage)) for x in batch.column(column)], pa.bool_()))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE,
    least: int = SEED, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, that are in no pair of contaminated(). Each row is judged by its own text
    where it lies, whatever its id; nothing is shuffled. Nulls, empty tables and repeated rows are as there."""
    column = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds(block, least))
        docs = docs.mapInArrow(lambda batches, seeds=seeds: _clean(batches, seeds.value, coverage, column), docs.schema)
    return docs


def op5_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("tiles", F.expr("array_join(transform(tiles, t -> concat_ws(':', t.item_start, t.doc_start, t.words)), ',')"))
