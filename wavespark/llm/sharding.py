"""Sharding by extendible hashing, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, table

#: Bits of the directory that one round looks at; its histogram has at most 2 ** STEP rows for each bucket being split.
STEP = 12
#: Bits taken from each of the two hashes: of the key, then of the key and the row.
HASH_BITS = 60
#: Byte limit of the query; small, so that the small test tables split too. write_shards defaults to SHARD_BYTES.
QUERY_BYTES = 1 << 20
SHARD_BYTES = 256 << 20


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, limit: int, at: int) -> DataFrame:
    """Splits the buckets (_bucket, depth at) that hold rows on up to STEP further bits.

    rows: _bucket (bits so far, as a string), _next (the next STEP bits, as a number), _bytes. Returns an entry for each
    directory slot in use: _bucket, _next, _bits (bits of the shard below _bucket; null if even STEP bits leave it over
    the limit), shard_bytes, shard_rows.
    """
    leaves = rows.groupBy("_bucket", "_next").agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
    levels = leaves.select("*", F.explode(F.sequence(F.lit(0 if at == 0 else 1), F.lit(STEP))).alias("_d"))
    prefix = F.call_function("shiftright", F.col("_next"), F.lit(STEP) - F.col("_d"))
    nodes = levels.groupBy("_bucket", "_d", prefix.alias("_p")).agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))
    # Bytes only shrink on the way down: the first level that fits is where extendible hashing stops splitting. A single
    # row is a shard of its own, whatever its size.
    fit = nodes.where((F.col("_b") <= limit) | (F.col("_n") == 1))
    slot = levels.select("_bucket", "_next", "_d", prefix.alias("_p"))
    found = (
        slot.join(fit, ["_bucket", "_d", "_p"]).groupBy("_bucket", "_next")
        .agg(F.min(F.struct("_d", "_b", "_n")).alias("_at"))
    )
    return leaves.select("_bucket", "_next").join(found, ["_bucket", "_next"], "left").select(
        "_bucket", "_next", F.col("_at._d").alias("_bits"), F.col("_at._b").alias("shard_bytes"), F.col("_at._n").alias("shard_rows")
    )


def shard(
    docs: DataFrame, key_col: str = "doc_id", size: Column | None = None, limit: int = QUERY_BYTES, carry: str | None = None
) -> DataFrame:
    """Deals rows to shards of at most limit bytes each; only buckets over the limit split, on one more hash bit.

    docs: any rows. size: bytes of a row, the UTF-8 length of text unless given. Returns key_col, bytes, shard (the hash
    prefix, as a string of bits; empty if everything fits into one), depth (its bits), shard_bytes and shard_rows, and
    the column carry, if one is named.

    The address of a row is 60 bits of the key's hash, then 60 bits of the hash of key and row. So a key that alone is
    over the limit, even a third of all rows, still splits; rows with one key stay together as far as they fit. Rounds
    look at 12 bits each, through histograms that combine before the shuffle; the first has at most 4,096 entries, the
    later ones at most so many for each bucket still too large. What is left for the next round is written once, so no
    round reads rows that have their shard already, or repeats a join; and no bucket is ever gathered.

    Defined results: null keys hash like the empty string; null sizes count 0 bytes. A row that is larger than the limit
    by itself is a shard of its own, over the limit (shard_rows is 1). Should 120 bits leave a bucket over the limit, that
    is an error; no row is left out. Empty tables give an empty result.
    """
    size = F.octet_length("text") if size is None else size
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    kept = [carry] if carry else []
    rows = docs.select(F.col(key_col).alias("_key"), key.alias("_text"), F.coalesce(size, F.lit(0)).cast("long").alias("_bytes"), *kept)
    # Written once: the sizes are then not computed again by every round, and row numbers stay as they are.
    rows = checkpoint(rows).withColumn("_nth", F.monotonically_increasing_id())
    pending = rows.withColumn("_bucket", F.lit(""))
    done: list[DataFrame] = []
    at = 0
    while True:
        hashed = _hash(F.col("_text")) if at < HASH_BITS else _hash(F.concat("_text", F.lit("#"), "_nth"))
        shift = HASH_BITS - STEP - at % HASH_BITS
        pending = pending.withColumn("_next", F.shiftright(hashed, shift).bitwiseAND(F.lit((1 << STEP) - 1)))
        directory = checkpoint(_directory(pending, limit, at))
        # In the first round the directory has at most 2 ** STEP entries, a fixed bound. Later ones may be any size.
        entries = F.broadcast(directory) if at == 0 else directory
        placed = pending.join(entries, ["_bucket", "_next"])
        bits = F.substring(F.lpad(F.bin("_next"), STEP, "0"), F.lit(1), F.coalesce("_bits", F.lit(STEP)))
        placed = placed.withColumn("_shard", F.concat("_bucket", bits))
        done.append(placed.where("_bits is not null").select("_key", "_bytes", "_shard", "shard_bytes", "shard_rows", *kept))
        at += STEP
        if directory.where("_bits is null").isEmpty():
            break
        if at == 2 * HASH_BITS:
            raise ValueError(f"{at} bits leave a bucket over the limit")
        pending = checkpoint(placed.where("_bits is null").select("_key", "_text", "_bytes", "_nth", F.col("_shard").alias("_bucket"), *kept))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("_key").alias(key_col), F.col("_bytes").alias("bytes"), F.col("_shard").alias("shard"),
        F.length("_shard").alias("depth"), "shard_bytes", "shard_rows", *kept,
    )


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES) -> None:
    """Writes the rows of docs, with all their columns, as Parquet in one folder shard=b<bits> for each shard; if docs has a
    column shard, the folders are named shard_=b<bits>. Nulls, large rows and empty tables are as in shard(); repeated
    rows are written as often as they come."""
    folder = fresh("shard", docs)
    size = F.octet_length("text") if size is None else size
    whole = docs.select(F.col(key_col).alias("_key"), F.coalesce(size, F.lit(0)).alias("_size"), F.struct(*docs.columns).alias("_whole"))
    placed = shard(whole, "_key", F.col("_size"), limit, carry="_whole")
    placed = placed.select("_whole.*", F.concat(F.lit("b"), "shard").alias(folder))
    placed.repartition(folder).write.partitionBy(folder).parquet(path)


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}))::BIGINT) AS h FROM documents
), n AS (
  SELECT k.depth, d.h >> ({HASH_BITS} - k.depth) AS p, sum(d.bytes) AS b, count(*) AS n
  FROM d, range(0, {2 * STEP + 1}) k(depth) GROUP BY ALL
), f AS (
  SELECT d.doc_id, d.bytes, d.h, min(n.depth) AS depth
  FROM d, n WHERE n.p = d.h >> ({HASH_BITS} - n.depth) AND (n.b <= {QUERY_BYTES} OR n.n = 1) GROUP BY ALL
)
SELECT f.doc_id, f.bytes, substr(right(repeat('0', 60) || bin(f.h), {HASH_BITS}), 1, f.depth::BIGINT) AS shard,
       f.depth::INTEGER AS depth, n.b::BIGINT AS shard_bytes, n.n AS shard_rows
FROM f JOIN n ON n.depth = f.depth AND n.p = f.h >> ({HASH_BITS} - f.depth)
"""
