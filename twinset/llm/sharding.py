"""Weighted rendezvous hashing of record keys into shards."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_slots, stored

#: Hex digits of the digest that make the uniform draw; 13 digits are 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from the key and the shard alone. A null key is a key of its own."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, numbered from 0, with the largest score weight / -ln(draw).

    A shard's expected share is its weight's. A shard more, or a larger weight, moves only the rows that the grown shard
    wins; a shard less moves only its own rows.
    """
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("score"), F.lit(-i).alias("last")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight above 0")
    return (-F.greatest(*scores)["last"] if len(scores) > 1 else F.lit(next(i for i, w in enumerate(weights) if w > 0))).cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Slots run from 0 in each shard by (key, size, text_crc32). Null text has no bytes and size 1; null keys share a
    shard, as all equal keys do. Rows of one key, however many, take slots over many tasks. Other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return dense_slots(stored(narrow, "shards"), "shard", ["doc_id", "size", "text_crc32"], "slot").withColumn("law", F.lit("key"))


def write_shards(docs: DataFrame, weights: list[float], path: str, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Writes docs under path/shard=N. A shard is split over files of some rows_per_file rows, so a hot shard is no single task."""
    placed = docs.withColumn("shard", rendezvous(F.col(key), weights))
    placed.repartition("shard", F.pmod(F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")]), F.lit(16))).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; nulls, empty texts, ties, repeated rows, other columns and an empty table as in assign()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs, [1.0] * 16, [1.0] * 17).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same in DuckDB: CRC32 by a table of 256 steps over the bytes, draws by MD5.
OP3_SQL = """
WITH tbl AS (SELECT list(CAST(c AS UBIGINT) ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS UBIGINT), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))),
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT d.*, hex(encode(text)) AS h FROM d),
c AS (SELECT rid, doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
             CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(h, '..'), lambda s: CAST('0x' || s AS UBIGINT))),
                 lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, tbl),
s AS (SELECT *, list_transform(range(17), lambda i: 1.0 / -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)) AS scores FROM c),
p AS (SELECT *, CAST(list_position(scores[1:16], list_max(scores[1:16])) - 1 AS INTEGER) AS shard, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""
