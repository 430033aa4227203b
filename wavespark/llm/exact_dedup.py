"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, fresh, row_key, table

#: Characters of the text that the second level hashes.
PREFIX_CHARS = 64
#: Bits of each level's filter of surviving groups: 1 MiB, whatever the input. A full filter sends more rows to the
#: next level than need go there; it never loses one.
FILTER_BITS = 1 << 23
#: Bits in one bitmap of Spark's bitmap_construct_agg.
BITMAP = 32768


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def _survivors(keys: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the key values that occur more than once: at most bits / 32768 rows of 4 KiB."""
    return bitmap_of(keys.groupBy("key").count().where("count > 1"), bits)


def bitmap_of(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps (bucket, bits) of the long column key: at most bits / 32768 rows of 4 KiB, whatever the keys' number."""
    slot = _slot(F.col("key"), bits)
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def with_test(df: DataFrame, key: Column, bitmaps: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds the boolean column name: may key be in the bitmaps? The broadcast side has a fixed size bound."""
    slot = _slot(key, bits)
    at = F.bitmap_bit_position(slot)
    bucket, bitmap = fresh("_bucket", df), fresh("_bitmap", df)
    side = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return df.join(side, F.bitmap_bucket_number(slot) == F.col(bucket), "left").withColumn(name, hit).drop(bucket, bitmap)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS,
    hash_col: str | None = None,
) -> DataFrame:
    """Finds the groups of equal texts; of each, the row with the largest id stays.

    Texts are equal when identical after lower-casing A-Z alone. Returns every row of docs, with all its columns except
    the text, and keep_id (the id that stays), group_size (rows in the group) and kept (is this row's id keep_id?).

    Level 1 counts byte lengths; level 2 hashes the first prefix_chars characters of rows whose length recurs; level 3
    takes SHA-256 of the whole text of rows whose length and prefix recur. Which groups survive a level goes to the next
    scan as bitmaps of a fixed size, so that texts are never shuffled and no group is gathered anywhere: counts combine
    before they are shuffled, and the last join, which gives each row its group's facts, reaches both sides through
    plain exchanges that adaptive execution splits where one group holds many rows.

    hash_col: the column that has the SHA-256 of the normalised text in hexadecimal digits, if there is one already.

    Defined results: a null text is the empty text. Equal rows with equal ids are all kept (they are one document;
    see deduplicate). A null id takes part; it stays only if all ids of its group are null. Columns of docs of the
    names keep_id, group_size and kept are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    flag = fresh("_full", docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _refined(docs, text_col, prefix_chars, filter_bits, flag)
    full = F.when(F.col(flag), F.sha2(ascii_lower(text), 256) if hash_col is None else F.col(hash_col))
    return _decide(rows.withColumn(flag, full).drop(text_col), id_col, flag)


def _refined(docs: DataFrame, text_col: str, prefix_chars: int, filter_bits: int, flag: str) -> DataFrame:
    """Adds the boolean column flag: do both the row's length and its prefix recur? True for every text that recurs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text)
    by_length = F.xxhash64(length)
    by_prefix = F.xxhash64(length, ascii_lower(F.substring(text, 1, prefix_chars)))
    lengths = _survivors(docs.select(by_length.alias("key")), filter_bits)
    level2 = with_test(docs.select(text_col), by_length, lengths, flag, filter_bits).where(F.col(flag))
    prefixes = _survivors(level2.select(by_prefix.alias("key")), filter_bits)
    rows = with_test(docs, by_length, lengths, flag, filter_bits)
    more = fresh("_more", rows)
    rows = with_test(rows, F.when(F.col(flag), by_prefix), prefixes, more, filter_bits)
    return rows.withColumn(flag, F.col(flag) & F.col(more)).drop(more)


def _decide(rows: DataFrame, id_col: str, full: str) -> DataFrame:
    """Gives each row with a full hash its group's size and largest id; rows without one stand alone."""
    key, keep, size = (fresh(c, rows) for c in ("_key", "_keep", "_size"))
    groups = (
        rows.where(F.col(full).isNotNull()).groupBy(full).agg(F.max(id_col).alias(keep), F.count("*").alias(size))
        .where(F.col(size) > 1).select(F.concat(F.lit("="), full).alias(key), keep, size)
    )
    # The key is rewritten so that the groups, too, come to the join by an exchange of its own; rows that stand alone
    # get keys that match nothing and are spread evenly.
    lone = F.concat(F.lit("lone"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = rows.withColumn(key, F.coalesce(F.concat(F.lit("="), full), lone))
    return (
        rows.join(groups, key, "left")
        .withColumn("keep_id", F.when(F.col(size).isNull(), F.col(id_col)).otherwise(F.col(keep)))
        .withColumn("group_size", F.coalesce(size, F.lit(1)).cast("long"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .drop(key, full, keep, size)
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each group, with the columns of docs in their order.

    Rows whose length or prefix doesn't recur pass straight through. Of the others, full hashes choose the rows that stay,
    and only these rows' texts are shuffled, by id and hash, so that a group of any size is spread over the tasks.

    Ids name documents, but repeated rows and even different texts under one id come out right: decisions are matched by
    id and text hash, and of rows alike in both, one stays. Nulls, ties and empty tables are as in exact_dedup.
    """
    flag, key, full = (fresh(c, docs) for c in ("_again", "_key", "_full"))
    rows = _refined(docs, text_col, prefix_chars, filter_bits, flag)
    again = rows.where(F.col(flag)).withColumn(full, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    again = again.withColumn(key, row_key(id_col, F.col(full)))
    stays = again.groupBy(full).agg(F.max(id_col).alias(id_col)).select(row_key(id_col, F.col(full)).alias(key))
    again = again.join(checkpoint(stays), key, "left_semi").dropDuplicates([key])
    return rows.where(~F.col(flag)).select(*docs.columns).unionAll(again.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    rows = docs.select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup(rows, hash_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
