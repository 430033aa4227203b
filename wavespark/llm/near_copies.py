"""Near copies by word-shingle similarity: wide SimHash sketches, fuzzy keys from Golay decodings, pairs verified by shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, exchanged, fresh, row_key, spread
from .exact_dedup import bitmap_of, with_test
from .groups import BLOCK, bounds, joining_links, spanning
from .simhash import CHUNK, GOLAY_LENGTH, SEED, SMALL, bit_counts, golay_keys, shingle_hashes, with_component

#: Words in a shingle, and the share of all distinct shingles of two linked texts that both have.
SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a sketch: keys are taken from all of them, the first CARRIED travel with the keys.
WORDS, CARRIED = 12, 3
#: Bits of the carried ones in which candidates may differ. At similarity 0.8 they differ in 29 on average, with deviation 5.
LIKELY = 50
#: Sketches whose keys are made at a time.
AT_ONCE = 1024
#: Shingles that weigh as much as one text by itself when families are dealt to tasks.
HEAVY = 512

#: Fixed values of the SplitMix64 generator.
STEP, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
COLUMNS = [f"s{k}" for k in range(CARRIED)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MIX_1
    x = (x ^ x >> np.uint64(27)) * MIX_2
    return x ^ x >> np.uint64(31)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order; of its whole word sequence if it has fewer words; none without words."""
    found = list(shingle_hashes(text, shingle, SEED))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """WORDS independent fingerprints of a set; a bit is set if it is in over half of the hashes, mixed anew for each word."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS if len(hashes) else 0):
        hashes = hashes + STEP
        counts = sum(bit_counts(mixed(hashes[at : at + CHUNK])) for at in range(0, len(hashes), CHUNK))
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def name_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, from all its members."""
    whole = np.bitwise_xor.reduce(mixed(hashes ^ STEP)) if len(hashes) else np.uint64(0)
    return int(mixed(np.array([whole + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(1):
            found = shingle_set(x.as_py(), shingle)
            rows.append((name_of(found), len(found), sketch(found)))
        words = np.array([r[2] for r in rows], np.uint64).reshape(-1, WORDS)
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(2)]
        columns += [pa.array(c) for c in np.ascontiguousarray(words.T).view(np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "print", "n", *(f"s{k}" for k in range(WORDS))])


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sketches (rows of words), and whose each is: for every 32-bit half of a word its upper 9 bits with the
    indices of the codewords near its lower 23. By the pigeonhole principle some half of two similar sketches has few
    differences: a half of a pair at similarity 0.8 meets in one of eight cases, so some half does in 0.97 of cases."""
    keys, whose = [], []
    for k in range(2 * words.shape[1]):
        half = (words[:, k // 2] >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        index, of = golay_keys(half & ((1 << GOLAY_LENGTH) - 1))
        keys.append(k << 40 | (half >> GOLAY_LENGTH)[of] << 12 | index)
        whose.append(of)
    return np.concatenate(keys), np.concatenate(whose)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
        name, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        keys, of = segment_keys(np.stack(words, 1).view(np.uint64))
        columns = [keys, name[of], np.ones(len(of), np.int32), *(w[of] for w in words[:CARRIED])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["grp", "name", "weight", *COLUMNS])


def likely_links(groups: np.ndarray, columns: list[pa.Array], trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between sketches of a group that differ in at most LIKELY of the carried bits. Groups of up to SMALL rows are
    compared all at once, by shifting whole batches."""
    words = np.stack([c.to_numpy() for c in columns], 1).view(np.uint64)
    start, sizes = bounds(groups)
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, SMALL):
        x, y = small[:-lag], small[lag:]
        same = groups[x] == groups[y]
        if not same.any():
            break
        x, y = x[same], y[same]
        near = (trees[x] != trees[y]) & (np.bitwise_count(words[x] ^ words[y]).sum(axis=1) <= LIKELY)
        xs.append(x[near])
        ys.append(y[near])
    for s, size in zip(start[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = words[s : s + size]
        x, y = joining_links(trees[s : s + size], lambda at, left, own=own: np.bitwise_count(own[left] ^ own[at]).sum(axis=1) <= LIKELY)
        xs.append(x + s)
        ys.append(y + s)
    return np.concatenate(xs), np.concatenate(ys)


class Sets:
    """The shingle sets of a family: how many shingles a row has in common with each of a shrinking choice of rows."""

    def __init__(self, hashes: np.ndarray, ends: np.ndarray):
        self.sizes = np.diff(ends)
        kinds, ids = np.unique(hashes, return_inverse=True)
        self.own = np.split(ids, ends[1:-1])
        self.mark = np.zeros(len(kinds), bool)
        self.rows, self.ids = np.arange(len(self.sizes)), ids

    def common(self, at: int, rows: np.ndarray) -> np.ndarray:
        if 2 * len(rows) < len(self.rows):
            self.rows, self.ids = rows, np.concatenate([self.own[r] for r in rows.tolist()])
        self.mark[self.own[at]] = True
        ends = np.r_[0, np.cumsum(self.sizes[self.rows])]
        found = np.r_[0, np.cumsum(self.mark[self.ids], dtype=np.int64)][ends]
        self.mark[self.own[at]] = False
        return np.diff(found)[np.searchsorted(self.rows, rows)]


def similar_links(groups: np.ndarray, columns: list[pa.Array], trees: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of a family whose sets of shingles have that Jaccard similarity: every link is verified."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lists = columns[0]
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for s, size in zip(*(b.tolist() for b in bounds(groups)), strict=True):
        sets = Sets(flat[ends[s] : ends[s + size]], ends[s : s + size + 1] - ends[s])

        def near(at: int, left: np.ndarray, sets: Sets = sets) -> np.ndarray:
            common = sets.common(at, left)
            return common >= similarity * (sets.sizes[at] + sets.sizes[left] - common)

        x, y = joining_links(trees[s : s + size], near)
        xs.append(x + s)
        ys.append(y + s)
    return np.concatenate(xs), np.concatenate(ys)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Names and shingle sets, a text at a time, so that no batch of very long texts is held twice."""
    for batch in batches:
        for x in batch.column(0):
            found = shingle_set(x.as_py(), shingle)
            columns = [pa.array([name_of(found)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "hashes"])


def _family_sets(docs: DataFrame, distinct: DataFrame, families: DataFrame, shingle: int) -> DataFrame:
    """Rows (grp, name, weight, hashes): the shingle set of each text of each family. Only such texts leave the scan of
    docs, which a bitmap of a fixed size picks by the id of one document of each."""
    wanted = checkpoint(exchanged(families, distinct.select(F.col("print").alias("node"), "least", "n"), "node"))
    bitmaps = bitmap_of(wanted.select(F.xxhash64("least").alias("key")))
    picked = with_test(docs, F.xxhash64("id"), bitmaps, "picked").where("picked").select("text")
    sets = picked.mapInArrow(lambda batches: _sets(batches, shingle), "name long, hashes array<long>").dropDuplicates(["name"])
    wanted = wanted.select(F.col("node").alias("name"), F.col("root").alias("grp"), (F.lit(1) + F.expr(f"n div {HEAVY}")).alias("weight"))
    return checkpoint(exchanged(sets, wanted, "name").select("grp", "name", "weight", "hashes"))


def near_copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """Groups documents by links between texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Returns one row for each row of docs: id_col, print (a 64-bit name of its set of shingles), component_id (the smallest
    id that links lead to, its own included). Words and case are as in simhash.fingerprint.

    Texts are read once for their sketches: twelve SimHash fingerprints of the set of shingles. Equal sets fall together
    first. Each distinct one has about 128 keys (see segment_keys); sketches under one key are compared by bits, whatever
    their number, and those that may be similar form families. The texts of families are read again, and within each
    family every link is verified by the shingles themselves; only what the verified links join goes out (see
    groups.spanning for families of any size). So no link is a guess; what may be missed is a pair that shares no key or
    is in no family, at a similarity of just 0.8 three in a hundred, above 0.85 hardly any.

    Defined results: null and wordless texts are similar to each other alone; a text of fewer words than a shingle to texts
    of the same words. Repeated rows are returned as often as they come. A null id takes part, but is a component_id only if
    the component has no other. Other columns are ignored. An empty table gives an empty result.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the sketches' limits are for a similarity of {SIMILARITY} or more")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind, words = docs.schema["id"].dataType.simpleString(), [f"s{k}" for k in range(WORDS)]
    found = docs.mapInArrow(lambda batches: _sketches(batches, shingle), f"id {kind}, print long, n long, " + ", ".join(f"{c} long" for c in words))
    prints = checkpoint(found)
    distinct = checkpoint(prints.groupBy("print").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", *words))))
    keys = spread(distinct.select("print", *words)).mapInArrow(_keys, "grp long, name long, weight int, " + ", ".join(f"{c} long" for c in COLUMNS))
    families = components(spanning(keys, likely_links, block))
    sets = _family_sets(docs, distinct, families, shingle)
    joined = components(spanning(sets, lambda *rows: similar_links(*rows, similarity), block))
    return with_component(prints.select("id", "print"), distinct.select("print", "least"), joined).withColumnRenamed("id", id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their groups (see near_copy_groups): of each, the one of the smallest id. Of texts
    under one id, each is judged by itself; of rows alike in both, one stays. Only texts of rows that may have to go, or are
    repeated, are shuffled: a bitmap of a fixed size tells the others apart. Nulls and empty tables are as in near_copy_groups."""
    key = row_key(id_col, F.xxhash64(text_col))
    slim = docs.select(F.struct(F.col(id_col).alias("id"), key.alias("key")).alias("id"), F.col(text_col).alias("text"))
    found = near_copy_groups(slim, "id", "text", **options).select("id.key", (F.col("id") == F.col("component_id")).alias("stays"))
    decided = found.groupBy("key").agg(F.count("*").alias("rows"), F.max("stays").alias("stays"))
    touched = checkpoint(decided.where("rows > 1 OR NOT stays"))
    mark, own, stays = (fresh(c, docs) for c in ("_touched", "_key", "_stays"))
    rows = with_test(docs.withColumn(own, key), F.xxhash64(own), bitmap_of(touched.select(F.xxhash64("key").alias("key"))), mark)
    again = exchanged(rows.where(mark), touched.select(F.col("key").alias(own), F.col("stays").alias(stays)), own, "left")
    again = again.where(F.coalesce(stays, F.lit(True))).dropDuplicates([own])
    return rows.where(~F.col(mark)).select(*docs.columns).unionAll(again.select(*docs.columns))
