"""Token counts with a digest cache: what was counted once under a tokenizer version is looked up, not encoded again."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_folder, stored, table
from .exact_dedup import FILTER_BITS, bitmap_of, with_test

CACHED = "content binary, n_tokens long, tokenizer string"
#: Bits of the filter of recurring texts: 16 for each of them, within these bounds (1 MiB and 32 MiB).
LEAST_BITS, MOST_BITS = FILTER_BITS, 1 << 28
#: Words whose counts a task remembers, and the longest it remembers, in bytes.
WORDS, WORD_BYTES = 1 << 19, 64
#: Tokens above which a document is over_limit.
LIMIT = 2048
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file (.json of the library tokenizers, .model of sentencepiece) that the driver and all executors have
    at the same path.

    folds: the tokenizer lower-cases, drops white space and never joins characters across it. Then texts in ASCII that
    differ only in case and white space share a digest, and words between ASCII white space are encoded one by one, each
    once a task while it is remembered.
    """

    path: str
    folds: bool = False

    @property
    def content(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()

    @property
    def version(self) -> str:
        """SHA-256 of the file, the library's version and how texts are passed to it: what a count depends on."""
        library = __import__("tokenizers" if self.path.endswith(".json") else "sentencepiece")
        how = f"{library.__name__} {library.__version__} no special tokens added, no truncation, no padding, folds {self.folds}"
        return hashlib.sha256(self.content + how.encode()).hexdigest()

    @property
    def specials(self) -> list[str]:
        """Strings that the tokenizer looks for before it folds case."""
        return [t["content"] for t in json.loads(self.content)["added_tokens"]] if self.path.endswith(".json") else []


def normalised(text: Column, vocabulary: Vocabulary) -> Column:
    """The text as it is digested. Only what can't change a count is levelled: in ASCII texts without special strings of a
    folding vocabulary, A-Z and white space. (Beyond ASCII case and composition of characters depend on each other.)"""
    text = F.coalesce(text, F.lit(""))
    if not vocabulary.folds:
        return text
    low = ascii_lower(text)
    plain = F.octet_length(text) == F.char_length(text)
    for special in vocabulary.specials:
        plain = plain & ~F.contains(low, F.lit(special.lower()))
    return F.when(plain, F.trim(F.regexp_replace(low, SPACE, " "))).otherwise(text)


class _Words(dict):
    """Counts by word; a word that isn't known is encoded. Full, it starts anew."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = n
        return n


@cache
def counter(vocabulary: Vocabulary, version: str):
    """A function from a text's bytes to its number of tokens. version: what the vocabulary must be here, too."""
    if vocabulary.version != version:
        raise ValueError(f"{vocabulary.path} or its library differs from the driver's")
    if vocabulary.path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        whole = lambda text: len(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False))
    else:
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=vocabulary.path)
        whole = lambda text: len(pieces.encode(text.decode("utf-8", "replace"), num_threads=1))
    if not vocabulary.folds:
        return whole
    words = _Words(whole)
    # split() of bytes knows ASCII white space alone, which the tokenizer drops wherever it stands.
    return lambda text: sum(map(words.__getitem__, text.split()))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, version: str) -> Iterator[pa.RecordBatch]:
    count = counter(vocabulary, version)
    for batch in batches:
        n = [count(text.as_py() or b"") for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """content (digest) and n_tokens stored under a tokenizer version, one row a digest; a cache not begun yet is empty."""
    try:
        found = spark.read.schema(CACHED).parquet(cache_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHED)
    # Two jobs may have added the same digests at the same time; their counts are equal.
    return found.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8) and n_tokens of every row's whole text, as the vocabulary's library counts it without adding
    special tokens; special strings in a text are what the library takes them for.

    1. Normalised texts are digested in a scan; digests go to the rows' table, texts stay.
    2. Distinct digests are joined to the cache's under the tokenizer's version; misses stay, each with one id.
    3. A second scan encodes one text of each miss, and digests and counts are appended to the cache.
    4. The rows are joined to the cache's counts.

    What is shuffled is digests. Texts are only where several rows share a text that misses (to be encoded once, they
    meet by id and digest) or, if the cache knows a part, where rows meet the misses; few misses are broadcast by Spark
    where its own size check allows it, and then no text moves. Texts that occur once are encoded in the scan; a filter of
    fixed bounds tells which may recur, and one that is full only sends more texts to the join. A text with a third
    of all rows is one row a task in the groupings; the joins split it where adaptive execution sees a large partition.

    The cache is a Parquet table, one folder a tokenizer version, appended by Spark's commit protocol: a task lost leaves
    nothing, a job that fails adds nothing, and one that is repeated finds what an earlier one added.

    Defined results: a null text counts as empty, with 0 bytes and 0 tokens. Rows come back as often as they are in docs, null
    ids too. Texts of any length are encoded whole. Other columns of docs are ignored, whatever their names. An empty
    table gives an empty result and adds nothing.
    """
    spark, version = docs.sparkSession, vocabulary.version
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(normalised(F.col(text_col), vocabulary), 256))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), content.alias("content"))
    rows = stored(slim.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content"))
    wanted = rows.groupBy("content").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    misses = stored(wanted.join(read_cache(spark, cache_path, version), "content", "left_anti"))
    count = misses.agg(F.count("*").alias("n"), F.sum("copies").alias("rows"), F.count(F.when(F.col("copies") > 1, 1)).alias("shared")).first()
    if count["n"]:
        meeting = F.xxhash64("content", "id")
        chosen = misses.select(meeting.alias("meeting"), F.col("content").alias("known")).hint("shuffle_hash")
        texts, alone = slim, slim.limit(0)
        if count["rows"] == rows.count():
            # Nothing is known yet, so a text that doesn't recur is a miss for certain.
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count["shared"]).bit_length()))
            recurring = bitmap_of(misses.where("copies > 1").select(F.xxhash64("content").alias("key")), bits)
            texts = with_test(slim, F.xxhash64("content"), recurring, "recurs", bits)
            texts, alone = texts.where("recurs"), texts.where("not recurs")
        texts = texts.withColumn("row", meeting).join(chosen, (F.col("row") == F.col("meeting")) & (F.col("content") == F.col("known")), "left_semi")
        encode = lambda df: df.select("content", "text").mapInArrow(lambda b: _encoded(b, vocabulary, version), "content binary, n_tokens long")
        counts = encode(alone).unionAll(encode(texts)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # The key is rewritten so that both sides come to the join by exchanges of their own, which can be split.
    key = F.concat(F.lit(b"="), F.col("content")).alias("key")
    known = read_cache(spark, cache_path, version).select(key, "n_tokens")
    return rows.select("id", "n_bytes", key).join(known, "key").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op12_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. The cache is the one that spark.wavespark.token_cache names or, if that is unset, a new one in
    the shared folder, so that every text is counted in the run."""
    import public_tokenizers

    cache_path = spark.conf.get("spark.wavespark.token_cache", None) or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"), folds=True)
    found = token_counts(table(spark, sf_dir, "documents"), cache_path, vocabulary)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
