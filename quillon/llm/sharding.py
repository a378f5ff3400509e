"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form one item, unless their bytes exceed a shard's share: then each of
SALTS hash classes of the group's rows is an item. Inside a block of items each item, largest first,
goes to the bin where the dot product of its vector with the bin's residual capacity is highest.
Items that fit in one block are packed into the shards. More are dealt to blocks by a hash and packed
into bins, which are the items of the next level, until they fit in one block. So no task and no
driver holds more than a block at any size; a layout depends on BLOCK_ITEMS, the balance doesn't.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, workspace

SALTS = 256
#: Items in a block, and the bins that a block of a level below the last fills.
BLOCK_ITEMS = 20_000
BLOCK_BINS = 256


def pack(vectors: np.ndarray, n_bins: int, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """Bin of each row of ``vectors`` (items by dimensions). ``weights``: of the dimensions in the product.

    Dimensions are scaled to sum to 1, so that a bin's capacity is 1/n_bins in each. Items go
    largest first; ties keep the items' order, and among equal products the lowest bin wins.
    """
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total, 1)
    residual = np.full((n_bins, vectors.shape[1]), 1.0 / n_bins)
    wanted = scaled * (np.ones(vectors.shape[1]) if weights is None else np.asarray(weights))
    out = np.empty(len(vectors), np.int32)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        best = int((residual @ wanted[i]).argmax())
        out[i] = best
        residual[best] -= scaled[i]
    return out


#: Bytes count most: they are what shards must agree in; tokens and rows follow closely.
WEIGHTS = (4.0, 1.0, 1.0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), tokens (blank-separated), CRC-32, text hash and salt."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("bigint").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _items(rows: DataFrame, n_shards: int) -> DataFrame:
    """One row per item: digest, piece, parts (its salts with their totals)."""
    by_salt = rows.groupBy("digest", "salt").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens")
    )
    part = F.struct("salt", "n_rows", "bytes", "tokens")
    groups = by_salt.groupBy("digest").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.sum("bytes").alias("group_bytes")
    )
    share = (rows.agg(F.sum("size")).first()[0] or 0) / n_shards
    one = F.array(F.col("parts"))
    each = F.transform("parts", lambda p: F.array(p))
    return groups.select(
        "digest",
        F.posexplode(F.when(F.col("group_bytes") > share, each).otherwise(one)).alias("piece", "parts"),
    )


_SIZES = ["bytes", "tokens", "n_rows"]


def _packed(items: DataFrame, keys: list[str], n_blocks: int, bins: int) -> DataFrame:
    """``items`` with their bin (a number over all blocks) and base, the rows before them in the bin."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", *keys], ascending=[False, *(True for _ in keys)], ignore_index=True)
        pdf["bin"] = pdf["block"].astype("int64") * bins + pack(pdf[_SIZES].to_numpy(float), bins, WEIGHTS)
        pdf["base"] = pdf.groupby("bin")["n_rows"].cumsum() - pdf["n_rows"]
        return pdf.drop(columns="block")

    dealt = items.select(F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int").alias("block"), *keys, *_SIZES)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name != "block")
    return dealt.groupBy("block").applyInPandas(block, f"{kinds}, bin bigint, base bigint")


def _places(items: DataFrame, n_shards: int, at: str) -> DataFrame:
    """digest, piece, shard and first slot of every item."""
    size = max(BLOCK_ITEMS, 64 * n_shards)
    bins = max(1, min(max(BLOCK_BINS, 16 * n_shards), size // 4))
    levels: list[tuple[DataFrame, list[str]]] = []
    keys = ["digest", "piece"]
    while True:
        n = items.count()
        last = n <= size
        packed = _packed(items, keys, 1 if last else -(-n // size), n_shards if last else bins)
        packed = materialize(packed, f"{at}/level{len(levels)}")
        levels.append((packed, keys))
        if last:
            break
        items = packed.groupBy(F.col("bin").alias("item")).agg(*(F.sum(c).alias(c) for c in _SIZES))
        items, keys = materialize(items, f"{at}/bins{len(levels)}"), ["item"]
    packed, keys = levels.pop()
    places = packed.select(*keys, F.col("bin").cast("int").alias("shard"), F.col("base").alias("first"))
    while levels:
        packed, keys = levels.pop()
        above = places.select(F.col("item").alias("bin"), "shard", "first")
        places = packed.join(above, "bin").select(*keys, "shard", (F.col("first") + F.col("base")).alias("first"))
    return places


def assign(docs: DataFrame, n_shards: int) -> DataFrame:
    """Shard and slot of every row: doc_id, size, tokens, text_crc32, shard, slot.

    Null texts weigh 1 byte. Repeated rows and copies share their text's shard; only a group of more
    bytes than a shard's share of all is dealt to several. Slots are gapless from 0 in each shard. An
    empty table gives no rows; other columns of ``docs`` don't matter.
    """
    at = workspace(docs.sparkSession, "shards")
    rows = materialize(measure(docs), f"{at}/rows")
    total = lambda c: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p[c])
    items = _items(rows, n_shards).select("digest", "piece", "parts", *(total(c).alias(c) for c in _SIZES))
    items = materialize(items, f"{at}/items")
    placed = _places(items, n_shards, at)
    # back to (digest, salt), with each salt's first slot
    parts = items.select("digest", "piece", F.explode("parts").alias("p"))
    in_piece = Window.partitionBy("digest", "piece").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = (
        parts.select("digest", "piece", F.col("p.salt").alias("salt"), F.col("p.n_rows").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(in_piece), F.lit(0)))
        .join(placed, ["digest", "piece"])
        .select("digest", "salt", "shard", (F.col("first") + F.col("before")).alias("first_slot"))
    )
    rank = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id")) - 1
    return (
        rows.join(salts, ["digest", "salt"])
        .withColumn("slot", F.col("first_slot") + rank)
        .select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
