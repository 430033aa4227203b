"""Near-duplicate groups by SimHash fingerprints, searched with fuzzy keys from the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, exchanged, spread, table
from .groups import BLOCK, bounds, joining_links, spanning

#: Words in a shingle, the hash's seed, and the bits in which linked fingerprints may differ, as the query's contract has them.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Groups up to this size are compared all at once, by shifting whole batches; larger ones one by one.
SMALL = 16
#: Shingles hashed at a time, so that a text of any length needs a fixed amount of memory.
CHUNK = 1 << 16

#: Fixed values of the perfect binary Golay code: length, check bits, generator x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_LENGTH, GOLAY_CHECK, GOLAY_POLYNOMIAL = 23, 11, 0b110001110101
#: First bit and bits of the three segments of a half.
SEGMENTS = (0, 11), (11, 11), (22, 10)


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, CHUNK at a time: of all its words if they are fewer, none without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII white spaces alone
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :].tolist() or [len(line)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(last), CHUNK):
        yield np.array([digest(line[i:j], seed) for i, j in zip(first[k : k + CHUNK], last[k : k + CHUNK], strict=True)], "<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; one is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, shingle, seed):
        n += len(hashes)
        counts += bit_counts(hashes)
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "print"])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of every byte at each of three places; the error patterns of up to four bits with each check value,
    padded to six; and how many there are. The code is perfect with radius 3, and a word at that distance from its
    codeword has five more at distance 4, so there are one or six."""
    residue = []
    for k in range(GOLAY_LENGTH + 1):
        x = 1 << k
        for j in range(k, GOLAY_CHECK - 1, -1):
            if x >> j & 1:
                x ^= GOLAY_POLYNOMIAL << (j - GOLAY_CHECK)
        residue.append(x)
    places = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1:
                    places[place, byte] ^= residue[8 * place + bit]
    patterns, counts = np.zeros((1 << GOLAY_CHECK, 6), np.int64), np.zeros(1 << GOLAY_CHECK, np.int64)
    for weight in range(5):
        for bits in combinations(range(GOLAY_LENGTH), weight):
            check = 0
            for b in bits:
                check ^= residue[b]
            patterns[check, counts[check]] = sum(1 << b for b in bits)
            counts[check] += 1
    return places, patterns, counts


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of all codewords within distance 4 of each 23-bit word, and which word each belongs to.

    Two words that differ in one bit share a key: if a word is within distance 3 of a codeword, as every word is of one,
    the other is within distance 4 of it.
    """
    places, patterns, counts = golay_tables()
    check = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]
    n = counts[check]
    of = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return (words[of] ^ patterns[check[of], nth]) >> GOLAY_CHECK, of


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 32 bits or more such that any two fingerprints that differ in at most three bits share one; and whose each is.

    By the pigeonhole principle one 32-bit half has at most one error. If it has none, it is itself a key. If it has one,
    the other half has two at most, so one of that half's three segments has none and makes the key selective. With it go,
    if the error is among the lower 23 bits, the upper 9 and an index of the Golay decodings; else the lower 23.
    """
    keys, whose = [], []
    every, ones = np.arange(len(prints)), (1 << 32) - 1
    for half in range(2):
        word = (prints >> np.uint64(32 * half) & np.uint64(ones)).astype(np.int64)
        other = (prints >> np.uint64(32 * (1 - half)) & np.uint64(ones)).astype(np.int64)
        low, high = word & ((1 << GOLAY_LENGTH) - 1), word >> GOLAY_LENGTH
        index, of = golay_keys(low)
        keys.append(half << 62 | word)
        whose.append(every)
        for k, (first, bits) in enumerate(SEGMENTS):
            segment = other >> first & ((1 << bits) - 1)
            tag = half << 62 | (2 * k + 1) << 40
            keys += [tag | segment[of] << 21 | high[of] << 12 | index, tag + (1 << 40) | segment << GOLAY_LENGTH | low]
            whose += [of, every]
    return np.concatenate(keys), np.concatenate(whose)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, CHUNK >> 5) for whole in batches for at in range(0, whole.num_rows, CHUNK >> 5)):
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        keys, of = fuzzy_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[of]), pa.array(prints[of]), pa.array(np.ones(len(of), np.int32))], ["grp", "name", "bits", "weight"])


def group_links(groups: np.ndarray, columns: list[pa.Array], trees: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (x, y) within each group of rows, which are sorted by group and carry their fingerprints."""
    prints = columns[0].to_numpy().view(np.uint64)
    start, sizes = bounds(groups)
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, SMALL):
        x, y = small[:-lag], small[lag:]
        same = groups[x] == groups[y]
        if not same.any():
            break
        near = same & (trees[x] != trees[y])
        x, y = x[near], y[near]
        near = np.bitwise_count(prints[x] ^ prints[y]) <= radius
        xs.append(x[near])
        ys.append(y[near])
    for s, size in zip(start[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = prints[s : s + size]
        x, y = joining_links(trees[s : s + size], lambda at, left, own=own: np.bitwise_count(own[left] ^ own[at]) <= radius)
        xs.append(x + s)
        ys.append(y + s)
    return np.concatenate(xs), np.concatenate(ys)


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a table with the single column print, that join just what all links would
    join: those between fingerprints that differ in at most radius bits (3 at most)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys find differences of up to {RADIUS} bits")
    keys = spread(prints).mapInArrow(_keys, "grp long, name long, bits long, weight int")
    return spanning(keys, lambda *rows: group_links(*rows, radius), block)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS
) -> DataFrame:
    """Groups documents by links between SimHash fingerprints that differ in at most radius bits.

    Returns one row for each row of docs: id_col, print (the 64 bits as a signed long), component_id (the smallest id that
    links lead to, its own included).

    Texts are read once, where they lie, and only ids and fingerprints leave that scan. Equal fingerprints fall together
    before anything is compared, so exact copies cost nothing further. Each distinct fingerprint gets about forty keys of
    32 bits or more (see fuzzy_keys), so that two unlike ones meet once in a hundred million cases; those under one key
    are compared exactly, and what goes out joins what the links found join, never all pairs of a group (see
    groups.spanning for groups of any size). Links are joined by distributed connected components.

    Defined results: null and wordless texts have fingerprint zero, linked like any other. Repeated rows are returned as
    often as they come. A null id takes part, but is a component_id only if the component has no other id. Other columns
    of docs are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    prints = checkpoint(docs.mapInArrow(lambda batches: _fingerprints(batches, shingle, seed), f"id {kind}, print long"))
    distinct = checkpoint(prints.groupBy("print").agg(F.min("id").alias("least")))
    return with_component(prints, distinct, components(links(distinct.select("print"), radius))).withColumnRenamed("id", id_col)


def with_component(prints: DataFrame, distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (id, print, component_id) of prints (id, print, ...); joined has (node, root) of prints that have links, and
    distinct each print's smallest id as least."""
    roots = exchanged(distinct, joined.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    # Only fingerprints that have links need the smallest id of their component.
    least = checkpoint(exchanged(joined, distinct, joined["node"] == distinct["print"]).groupBy("root").agg(F.min("least").alias("component_id")))
    named = exchanged(roots, least, "root", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    return exchanged(prints, named, "print").select("id", "print", "component_id")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
