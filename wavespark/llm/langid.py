"""Language identification with bit-sliced Bloom filters: one lookup returns all languages that have an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of an n-gram, word boundaries included.
GRAM = 4
#: Documents of each language that the filters are built from at most, those of the lowest id hash.
SAMPLE_PER_LANG = 2000
#: An n-gram is put in a language's filter if it is in this share of the language's sampled documents at least: rarer
#: ones are mostly quotations, names and copies of other languages.
LEAST_SHARE = 0.01
#: Scripts that put no space between words (ranges of code points, south-east Asian and east Asian): single letters and
#: pairs of them are n-grams, too, as longer ones hardly ever recur.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: The pipeline rejects a text of which the filters know less than this share of the n-grams.
LEAST_KNOWN = 0.1
#: Slots of the filters and hashes of an n-gram. Each slot holds one bit for each language, in words of WORD bits.
SLOTS, HASHES, WORD = 1 << 20, 3, 64
#: Characters handled at a time, so that a text of any length needs a fixed amount of memory.
CHUNK = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Is a code point a letter?"""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _mixed(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ points.astype(np.uint64)) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def _short(points: np.ndarray, seen: int) -> Iterator[np.ndarray]:
    """Hashes of single letters and pairs of unspaced scripts that end after the first seen points."""
    unspaced = np.zeros(len(points), bool)
    for low, high in UNSPACED:
        unspaced |= (points >= low) & (points <= high)
    if unspaced.any():
        one = _mixed(np.full(len(points), 1, np.uint64), points)
        yield one[seen:][unspaced[seen:]]
        start = max(seen - 1, 0)
        pair = _mixed(_mixed(np.full(max(len(points) - 1, 0), 2, np.uint64), points[:-1]), points[1:])
        yield pair[start:][unspaced[start:-1] & unspaced[start + 1 :]]


def grams(text: str, n: int = GRAM) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased text, repeats included, in pieces. Runs of anything but letters count as
    one space; so do both ends. N-grams of more than one word are left out; of unspaced scripts there are shorter ones, too."""
    tail = np.zeros(1, np.uint32)
    for k in range(0, len(text), CHUNK):
        points = np.frombuffer(text[k : k + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.r_[tail, np.where(_letters()[points], points, np.uint32(0))]
        if k + CHUNK >= len(text):
            points = np.r_[points, np.zeros(1, np.uint32)]
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
        points, seen = points[keep], len(tail)
        yield from _short(points, seen)
        tail = points[-(n - 1) :]
        if len(points) < n:
            tail = points
            continue
        hashes = np.zeros(len(points) - n + 1, np.uint64)
        inner = np.zeros(len(hashes), bool)
        for j in range(n):
            at = points[j : j + len(hashes)]
            hashes = _mixed(hashes, at)
            if 0 < j < n - 1:
                inner |= at == 0
        yield hashes[~inner]


def slots(hashes: np.ndarray, slot_count: int = SLOTS, hash_count: int = HASHES) -> np.ndarray:
    """One row of slots for each hash function, by double hashing."""
    first, step = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return np.stack([((first + np.uint64(k) * step) % np.uint64(slot_count)).astype(np.int64) for k in range(hash_count)])


@dataclass(frozen=True)
class LanguageFilters:
    langs: list[str]  # in the order of their bits
    usual: str | None  # the most frequent one
    masks: np.ndarray  # by slot, and by word if languages need several
    hash_count: int
    gram: int

    @property
    def false_rates(self) -> np.ndarray:
        """The share of n-grams in no filter that a language's filter has nevertheless: its fill to the power of the hashes."""
        masks = self.masks.reshape(len(self.masks), -1)
        fill = np.array([(masks[:, k // WORD] >> np.uint64(k % WORD) & np.uint64(1)).mean() for k in range(len(self.langs))])
        return fill**self.hash_count

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-grams each language's filter has, and how many there are."""
        found, total = np.zeros(len(self.langs), np.int64), 0
        masks = self.masks.reshape(len(self.masks), -1)
        for hashes in grams(text, self.gram):
            at = slots(hashes, len(masks), self.hash_count)
            mask = masks[at[0]]
            for more in at[1:]:
                mask = mask & masks[more]
            total += len(mask)
            for k in range(len(self.langs)):
                found[k] += np.count_nonzero(mask[:, k // WORD] & np.uint64(1 << k % WORD))
        return found, total

    def judge(self, text: str | None, rates: np.ndarray) -> tuple[str, float, float]:
        """The language, its share of all languages' counts, and the share of the text's n-grams that it accounts for (1 for a
        text with letters but no n-grams, or if nothing could be learned: nothing speaks against such a text)."""
        if not lettered(text):
            return "und", 0.0, 0.0
        if not self.langs:
            return "und", 0.0, 1.0
        found, total = self.counts(text)
        true = np.clip((found - total * rates) / np.maximum(1 - rates, 1e-9), 0, None)
        if not true.sum():
            return self.usual, 0.0, 0.0 if total else 1.0
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum()), float(true[best] / total)

    def predict(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        return self.judge(text, rates)[:2]


def _document_grams(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """In how many documents of a batch each n-gram of each language is."""
    for batch in batches:
        of: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pieces = [np.unique(x) for x in grams(text.as_py() or "", gram)]
            if pieces:
                of.setdefault(lang, []).append(np.unique(np.concatenate(pieces)))
        for lang, found in of.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "docs"])


def _gram_slots(batches: Iterator[pa.RecordBatch], slot_count: int, hash_count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), slot_count, hash_count)
        word, mask = (np.tile(c.to_numpy(zero_copy_only=False), hash_count) for c in batch.columns[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(word), pa.array(mask)], ["slot", "word", "mask"])


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, gram: int = GRAM,
    per_lang: int = SAMPLE_PER_LANG, least_share: float = LEAST_SHARE, slot_count: int = SLOTS, hash_count: int = HASHES,
) -> LanguageFilters:
    """Builds the filters from up to per_lang documents of each language; rows without a language are left out.

    Defined results: null and letterless texts add nothing, repeated rows count as often as they come, texts of any length
    are read whole. A table without languages gives filters without any, which call everything `und`.

    All languages take part. What comes to the driver is bounded by their number: a row for each language, and for every
    64 of them one mask for each slot at most.
    """
    docs = docs.where(F.col(lang_col).isNotNull())
    sizes = docs.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()
    if not sizes:
        return LanguageFilters([], None, np.zeros(slot_count, np.uint64), hash_count, gram)
    langs = sorted(r[0] for r in sizes)
    # Hash thresholds stand in for ranks: about per_lang documents of each language are below theirs, and choosing them
    # needs no sort of the table. They come out the same wherever and however often the rows are read.
    number, spark = {lang: k for k, lang in enumerate(langs)}, docs.sparkSession
    known = [(r[0], number[r[0]] // WORD, number[r[0]] % WORD, min(1.0, per_lang / r["count"]), max(2.0, least_share * min(per_lang, r["count"]))) for r in sizes]
    known = F.broadcast(spark.createDataFrame(known, "lang string, word int, bit int, most double, least double"))  # a row a language
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    slim = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), share.alias("share"))
    sample = slim.join(known, "lang").where("share < most").select("lang", "text")
    by_lang = sample.mapInArrow(lambda batches: _document_grams(batches, gram), "lang string, gram long, docs long")
    kept = by_lang.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).join(known, "lang").where("docs >= least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    masks = kept.groupBy("gram", "word").agg(F.bit_or(bit).alias("mask"))
    masks = masks.mapInArrow(lambda batches: _gram_slots(batches, slot_count, hash_count), "slot long, word int, mask long")
    found = masks.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table_ = np.zeros((slot_count, -(-len(langs) // WORD)), np.uint64)
    table_[found["slot"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilters(langs, sizes[0][0], table_, hash_count, gram)


def _predictions(batches: Iterator[pa.RecordBatch], filters: LanguageFilters) -> Iterator[pa.RecordBatch]:
    rates = filters.false_rates
    for batch in batches:
        found = [filters.predict(x.as_py(), rates) for x in batch.column(batch.num_columns - 1)]
        columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns keep of docs (all but these two, if none are named).

    lang_pred is the language whose filter has most of the text's n-grams, after taking off those that it would have by
    chance; score is its share of these corrected counts over all languages. Every text is read whole, in one pass that
    shuffles nothing; the filters, of a fixed size, go to the executors with the task.

    Defined results: `und` with score 0 for a null text, one without a letter, or if nothing could be learned. A text
    with letters but none of any filter's n-grams gets the most frequent language with score 0. Among equal counts the
    language first in code-point order wins. Rows are returned as often as they come; an empty table gives none.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    slim = docs.select(*keep, F.col(text_col).alias("_read"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes[:-1]) + ", lang_pred string, score double"
    return slim.mapInArrow(lambda batches: _predictions(batches, shared.value), schema)


def _identified(batches: Iterator[pa.RecordBatch], filters: LanguageFilters, column: int, least_known: float) -> Iterator[pa.RecordBatch]:
    rates = filters.false_rates
    for batch in batches:
        known = [filters.judge(x.as_py(), rates)[2] for x in batch.column(column)]
        yield batch.filter(pa.array([x > 0 and x >= least_known for x in known], pa.bool_()))


def identified(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of docs, with all their columns, that are in a language of the filters: those of whose n-grams the predicted
    language's filter has least_known or more, after taking off what it would have by chance.

    Defined results: null texts and those without a letter go. Texts with letters but without n-grams (too short for one)
    stay, and so does everything with letters if nothing could be learned. Repeated rows share their fate. Texts are read
    whole, however long; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    column = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _identified(batches, shared.value, column, least_known), docs.schema)


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), filters, keep=["doc_id", "held_out"])
