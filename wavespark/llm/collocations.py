"""Collocations: phrases whose parts meet far more often than chance, from exact counts of whole texts."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: Where texts are cut into pieces, and pieces into words.
CUTS, GAPS = "[.,;:!?\\x0A-\\x0D]", "[ \\t]+"
LONGEST, LEAST, SHARE, FIRST = 5, 100, 100, 2000
#: Memory in MB of the database in a task; what is above goes to the task's scratch folder.
MEMORY_MB = 256
#: Bytes of text whose phrases are made at once.
PORTION = 1 << 22
#: Bits of the filter of frequent phrases: 16 for each, within these bounds (1 MiB and 32 MiB).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28
#: Shares of what is asked of one word, and of one language.
SALT = 16

#: A phrase with its language in front, so that a row that is shuffled has one string: no word holds the mark between them.
MARK = "\t"
COUNTS = pa.schema([("gram", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, piece (its words, joined by single spaces), words (how many) and times (how often it comes), of every
    distinct piece. Texts become pieces in the scan and equal ones are added up before they are shuffled, so a line that
    a third of all documents hold is one row a task."""
    found = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text_col, CUTS, -1)).alias("piece"))
    # Case is levelled, and blanks where there are several, piece by piece: most pieces are ASCII with single spaces.
    single = ~F.contains("piece", F.lit("\t")) & ~F.contains("piece", F.lit("  "))
    low = ascii_lower(F.when(single, F.col("piece")).otherwise(F.regexp_replace("piece", GAPS, " ")))
    found = found.select("lang", F.trim(low).alias("piece")).where("piece <> ''")
    counted = found.groupBy("lang", "piece").agg(F.count("*").alias("times"))
    return counted.select("lang", "piece", F.size(F.split("piece", " ")).cast("long").alias("words"), "times")


def _database(memory_mb: int):
    """A database of its own for a task, and its scratch folder beside Spark's own spills."""
    import duckdb

    base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    scratch = tempfile.mkdtemp(prefix="phrases-", dir=base if base and os.path.isdir(base) else None)
    settings = {"memory_limit": f"{memory_mb}MB", "temp_directory": scratch, "threads": "1", "preserve_insertion_order": "false"}
    return duckdb.connect(config=settings), scratch


def summed(batches: Iterator[pa.RecordBatch], least: int, memory_mb: int) -> Iterator[pa.RecordBatch]:
    """Sums f by gram out of core, of rows that stream through the database; phrases of fewer than least go."""
    db, scratch = _database(memory_mb)
    try:
        db.register("grams", pa.RecordBatchReader.from_batches(COUNTS, (b.cast(COUNTS) for b in batches)))
        found = db.sql(f"SELECT gram, sum(f)::BIGINT AS f FROM grams GROUP BY gram HAVING sum(f) >= {least}")
        yield from (b.cast(COUNTS) for b in found.to_arrow_reader(1 << 16))
    finally:
        db.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _keyed(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Counted phrases of the length as lang, gram, key and f."""
    parts = pc.split_pattern(batch.column(0), MARK, max_splits=1, reverse=True)
    lang, gram = pc.list_element(parts, 0), pc.list_element(parts, 1)
    words = pc.split_pattern(gram, " ")
    keys = _hashes(lang)
    for k in range(length):
        keys = _mixed(keys, _hashes(pc.list_element(words, k)))
    return pa.RecordBatch.from_arrays([lang, gram, pa.array(keys.view(np.int64)), batch.column(1)], ["lang", "gram", "key", "f"])


def _mixed(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases one word longer, from theirs and the last word's (all uint64). Keys only serve as filters."""
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words
    return keys ^ (keys >> np.uint64(32))


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, taken once for each distinct one."""
    coded = strings.dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return distinct[coded.indices.to_numpy()]


def _phrases(batch: pa.RecordBatch, length: int, frequent: np.ndarray | None) -> pa.RecordBatch:
    """Every phrase of the length, language in front, in a batch of pieces (lang, piece, times), both of whose parts of one
    word less may be frequent by the filter. Repeats are not added up yet."""
    lang, piece, times = batch.columns
    split = pc.split_pattern(piece, " ")
    words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy())
    owner = np.repeat(np.arange(len(batch)), pc.list_value_length(split).to_numpy())
    here = np.arange(len(words))
    if length > 1:
        of_word = _hashes(words)
        keys = _mixed(_hashes(lang)[owner], of_word)
        for k in range(1, length - 1):
            keys = _mixed(keys[:-1], of_word[k:])
        likely = _holds(frequent, keys)  # those of phrases that run over a piece's end mean nothing
        here = here[: len(likely) - 1]
        here = here[likely[:-1] & likely[1:] & (ends[owner[here]] - here >= length)]
    rows = pa.array(owner[here])
    gram = pc.binary_join_element_wise(*[words.take(pa.array(here + k)) for k in range(length)], " ")
    return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang.take(rows), gram, MARK), times.take(rows)], schema=COUNTS)


def _runs(batch: pa.RecordBatch, frequent: np.ndarray) -> pa.RecordBatch:
    """The longest runs of three words or more in a batch of pieces, every two neighbours of which may be a frequent phrase by
    the filter: as pieces, with their words and times."""
    lang, piece, times = batch.columns
    split = pc.split_pattern(piece, " ")
    words = split.flatten()
    owner = np.repeat(np.arange(len(batch)), pc.list_value_length(split).to_numpy())
    of_word = _hashes(words)
    pairs = _mixed(_mixed(_hashes(lang)[owner], of_word)[:-1], of_word[1:])
    likely = _holds(frequent, pairs) & (owner[:-1] == owner[1:])
    change = np.diff(np.pad(likely.astype(np.int8), 1))
    starts, sizes = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - np.flatnonzero(change == 1) + 1
    starts, sizes = starts[sizes > 2], sizes[sizes > 2]
    offsets = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(at))), " ")
    rows = pa.array(owner[starts])
    return pa.RecordBatch.from_arrays([lang.take(rows), joined, pa.array(sizes, pa.int64()), times.take(rows)], ["lang", "piece", "words", "times"])


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pieces in parts of about PORTION bytes, so that its phrases fit; a longer piece is a part by itself."""
    total = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // PORTION
    starts = np.flatnonzero(np.diff(total, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
        yield batch.slice(start, end - start)


def _holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bitmap of the keys of frequent phrases. Its size is bounded, whatever their number: a full one lets rare phrases be
    counted and never loses a frequent one."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * frequent.count()).bit_length()))
    slot = F.pmod("key", F.lit(bits)) + 1  # Spark's bitmaps count from one
    parts = frequent.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = np.zeros(bits // 8, np.uint8)
    for part, held in parts.toLocalIterator():
        found[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)
    return found


def frequent_phrases(found: DataFrame, length: int, least: int = LEAST, shorter: DataFrame | None = None, memory_mb: int = MEMORY_MB) -> DataFrame:
    """lang, gram, key and f (long) of all phrases of the length that occur least times in the pieces, times counted.

    shorter: those of one word less. A phrase is rarer than its parts, so only phrases of two frequent parts are counted:
    a filter of the frequent ones is broadcast, of bounded size. Each hash bucket of pieces is counted by a database in the
    task, out of core; sums are dealt to hash buckets of phrases, and each bucket adds them up in the same way. A phrase is
    one row a bucket of pieces when it is shuffled, however frequent.
    """
    context = found.sparkSession.sparkContext
    known: Broadcast | None = None if shorter is None else context.broadcast(_filter(shorter))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((_phrases(p, length, known and known.value) for b in batches for p in _portions(b)), 1, memory_mb)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_keyed(b, length) for b in summed(batches, least, memory_mb))

    slim = found.where(F.col("words") >= length).select("lang", "piece", "times")
    partial = slim.mapInArrow(count, "gram string, f long")
    return partial.repartition("gram").mapInArrow(add_up, "lang string, gram string, key long, f long")


def frequent_runs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """What of the pieces may hold frequent phrases of three words or more, as pieces: every phrase's neighbours are frequent
    pairs themselves, so it lies in a run of such pairs. Longer phrases are counted in these runs alone."""
    known = found.sparkSession.sparkContext.broadcast(_filter(pairs))
    slim = found.where("words > 2").select("lang", "piece", "times")
    return slim.mapInArrow(lambda batches: (_runs(p, known.value) for b in batches for p in _portions(b)), "lang string, piece string, words long, times long")


def _words(phrase: str, start: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


def score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)) of long columns, exactly: products are decimals of 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    return F.expr(f"({big(1000)} * {big(a)} * {big(n)}) div ({big(l)} * {big(r)})")


def scored(frequent: DataFrame, sizes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates with their lowest cut: lang, phrase, words, a, l, r, n, score.

    frequent: lang, gram, words, f of phrases of 1 to longest words; sizes: lang, n. Each candidate asks for the counts of
    its parts, a request for each cut and side; requests and counts meet by shuffles on language and part. A word that
    opens or ends a large share of all phrases is asked in SALT shares, and so are the languages' sizes.
    """
    share = F.pmod(F.xxhash64("gram"), F.lit(SALT)).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    sized = frequent.where("words > 1").withColumn("share", share).join(sizes.withColumn("share", shares), ["lang", "share"])
    cuts = sized.select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), "n", "share", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _words("phrase", F.lit(1), F.col("k")).alias("part"), F.col("k").alias("size")),
        F.struct(F.lit("r").alias("side"), _words("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("part"), (F.col("words") - F.col("k")).alias("size")),
    )).alias("ask")
    asked = cuts.select("*", sides).select("lang", "phrase", "words", "a", "n", "k", "ask.side", "ask.part", F.when(F.col("ask.size") == 1, F.col("share")).otherwise(-1).alias("share"))
    answers = frequent.where(F.col("words") < longest).select("lang", F.col("gram").alias("part"), F.col("f").alias("found"), F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(-1))).alias("shares"))
    answers = answers.select("lang", "part", "found", F.explode("shares").alias("share"))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("found"))).alias(f"{side}{k}")
    answered = asked.join(answers, ["lang", "part", "share"]).groupBy("lang", "phrase").agg(
        *[F.max(c).alias(c) for c in ("words", "a", "n")], *[of(k, side) for k in range(1, longest) for side in ("l", "r")]
    )
    best = F.array_min(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score("a", "n", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]))
    return answered.withColumn("cut", best).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def independent(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that lie in no longer one of which 100 f is share times their own count or more. Each candidate sends its
    count to the phrases in it; of what comes to a phrase only the largest is shuffled and kept."""
    size, start = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"), F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start")
    inner = candidates.where("words > 2").select("lang", "phrase", "words", "a", size).select("*", start)
    within = inner.select("lang", _words("phrase", F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("holder"))
    return candidates.join(within, ["lang", "phrase"], "left").where(F.col("holder").isNull() | (F.lit(100) * F.col("holder") < F.lit(share) * F.col("a"))).drop("holder")


def ranked(candidates: DataFrame, first: int = FIRST) -> DataFrame:
    """The first of each language by score and count, both falling, then phrase, with rank. Each of SALT shares of a language
    sends its own first ones, so none is sorted as a whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    of_share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order)
    some = candidates.withColumn("rank", F.row_number().over(of_share)).where(F.col("rank") <= first)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, first: int = FIRST, memory_mb: int = MEMORY_MB
) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a (occurrences), l and r (of the parts at the cut of the lowest
    score), n (words of the language) and score, floor(1000 a n / (l r)).

    Texts, A-Z lower-cased, are cut at punctuation and line ends into pieces and these at blanks into words; phrases of 2 to
    longest words with least occurrences or more, within pieces, overlaps included, are candidates. Those are left out that
    lie in a longer candidate with share hundredths of their count. Counts are exact and cover all texts: a phrase is left
    uncounted only where a part of it is known to be too rare.

    Equal pieces are counted once with their multiplicity; pieces and the frequent phrases of each length are written and
    read again, so a lost executor costs a reread.

    Defined results: a null or empty text has no pieces; a null language is und and joins a language of that name, the empty
    one is a language. Repeated rows count as often as they come, ids play no part. Ties in score go to the cut with the
    shortest first part, ties in rank to the larger count and the first phrase bytewise. Pieces of any length are taken
    whole. Other columns of docs are ignored. An empty table, or one without frequent phrases, gives an empty result.
    """
    found = stored(pieces(docs, lang_col, text_col))
    sizes = found.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    shorter, frequent = None, None
    for length in range(1, longest + 1):
        if length == 3:
            found = stored(frequent_runs(found, shorter))
        shorter = stored(frequent_phrases(found, length, least, shorter, memory_mb))
        level = shorter.select("lang", "gram", F.lit(length).alias("words"), "f")
        frequent = level if frequent is None else frequent.unionAll(level)
    candidates = stored(scored(frequent, sizes, longest))
    return ranked(independent(candidates, share), first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, w, count(*) AS times FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM t) WHERE len(w) > 0 GROUP BY 1, 2
), sizes AS (
  SELECT lang, sum(times * len(w)) AS n FROM p GROUP BY 1
), spots AS (
  SELECT lang, w, times, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM p)
), f AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, sum(times)::BIGINT AS f FROM spots GROUP BY 1, 2, 3 HAVING sum(times) >= 100
), cuts AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), scores AS (
  SELECT c.*, u.f AS l, v.f AS r, n, ((1000::HUGEINT * a * n) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM cuts c JOIN f u ON u.lang = c.lang AND u.phrase = x JOIN f v ON v.lang = c.lang AND v.phrase = y JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), within AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + z - 1], ' ') AS phrase, max(f) AS holder
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM f WHERE m > 2)) GROUP BY 1, 2
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN within USING (lang, phrase) WHERE holder IS NULL OR 100 * holder < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
