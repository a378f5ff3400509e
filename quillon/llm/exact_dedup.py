"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table of one row per distinct text, bucketed and sorted by digest. A batch is reduced
to its distinct digests and sort-merge anti-joined with the index; what is new is appended. The batch
that brings a text first keeps it: later batches, with whatever doc_ids, only add copies.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import (
    ascii_lower,
    drop_on_release,
    free_name,
    materialize,
    quoted,
    row_hash,
    shared_dir,
    shuffle_parts,
    workspace,
)

#: A group of copies is dealt to as many tasks, by a hash of the row.
SALTS = 256
#: A whole table goes through the index in so many batches.
BATCHES = 2
#: Texts in a bucket of an index made for a table of known size, about 100 MB.
BUCKET_TEXTS = 1_000_000
INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"


class DigestIndex:
    """Table ``name``: digest, keep_id and the batch that brought it; bucketed and sorted by digest.

    ``buckets`` is fixed when the table is created; size it so that a bucket (about 100 bytes a text)
    fits in a task.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def temporary(cls, spark: SparkSession, texts: int = 0) -> "DigestIndex":
        """A new index for at most about ``texts`` texts, which ``release`` drops."""
        index = cls(spark, f"digest_index_{uuid.uuid4().hex}", max(shuffle_parts(spark), -(-texts // BUCKET_TEXTS)))
        drop_on_release(index.name, index.path())
        return index

    def path(self) -> str:
        return f"{shared_dir(self.spark)}/{self.name}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        self.create()
        return self.spark.table(self.name)

    def _writer(self, rows: DataFrame) -> DataFrameWriter:
        # one writer task for each bucket, so a bucket gains one sorted file a batch
        return (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
        )

    def create(self) -> None:
        """Make the empty table, unless it exists."""
        if not self.exists():
            none = self.spark.createDataFrame([], INDEX_SCHEMA)
            self._writer(none).option("path", self.path()).mode("errorifexists").saveAsTable(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add what ``groups`` (digest, keep_id) has and the index hasn't: sort-merge anti-join, append."""
        known = self.read().select("digest")
        fresh = groups.hint("merge").join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        # written first, since a table can't be appended to from a plan that reads it
        self._writer(materialize(fresh, workspace(self.spark, "fresh"))).mode("append").saveAsTable(self.name)

    def look_up(self, groups: DataFrame) -> DataFrame:
        """``groups`` with the index's keep_id and batch in place of their own keep_id."""
        return groups.drop("keep_id").hint("merge").join(self.read(), "digest")


def _digest() -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, salt and the SHA-256 of each whole text, A-Z lower-cased; null counts as empty."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _digest().alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: keep_id (largest doc_id), group_size and the salts it occurs with."""
    by_salt = rows.groupBy("digest", "salt").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    return by_salt.groupBy("digest").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Register one batch in ``index``; returns (rows, groups).

    ``rows``: one per document: doc_id, digest, salt. ``groups``: one per distinct text of the batch:
    digest, keep_id (the index's), group_size (in the batch), salts, known (another batch brought the
    text first, so none of these rows stays). Ties and repeated rows count as copies; null doc_ids
    are copies too but are kept only if all doc_ids of the text are null; an empty batch gives empty
    tables. ``batch`` names the batch: registering it again, after a lost driver say, changes nothing
    in the index and gives the same result; what a broken append left out is added then. Without a
    name each call is a batch of its own.
    """
    rows = materialize(digests(docs), workspace(docs.sparkSession, "digests"))
    batch = batch or uuid.uuid4().hex
    return rows, _seen(_register(rows, index, batch), index, [batch])


def _register(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The batch's own groups, after what is new of them has been appended."""
    groups = materialize(group_digests(rows), workspace(rows.sparkSession, "groups"))
    index.append(groups, batch)
    return groups


def _seen(groups: DataFrame, index: DigestIndex, own: list[str]) -> DataFrame:
    """``groups`` as the index has them. ``known``: none of the batches ``own`` brought the text."""
    seen = index.look_up(groups).withColumn("known", ~F.col("batch").isin(own)).drop("batch")
    return materialize(seen, workspace(groups.sparkSession, "seen"))


def deduplicate_table(
    docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, batches: int = BATCHES
) -> tuple[DataFrame, DataFrame]:
    """The same for a whole table, which goes through the index (one of its own, if none is given) in
    ``batches`` parts of descending doc_ids, so that the first part with a text has its largest doc_id.
    Rows without a doc_id are in the last. group_size counts all parts. Without a name ``batch`` each
    call brings a table of its own; only under a name that was given may a table be registered again."""
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    rows = materialize(digests(docs), workspace(spark, "digests"))
    index = index or DigestIndex.temporary(spark, rows.count())
    steps = [i / batches for i in range(1, batches)]
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)))).first()[0] or [])) if steps else []
    number = F.lit(len(cuts))
    for i, cut in enumerate(cuts):
        number = F.when(F.col("doc_id") > cut, len(cuts) - 1 - i).otherwise(number)
    names = [f"{batch}-{i}" for i in range(batches)]
    parts = [_register(rows.filter(number == i), index, name) for i, name in enumerate(names[: len(cuts) + 1])]
    every = reduce(DataFrame.unionByName, (p.drop("keep_id") for p in parts))
    sums = every.groupBy("digest").agg(
        F.sum("group_size").alias("group_size"), F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts")
    )
    return rows, _seen(sums, index, names)


def decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Joins on (digest, salt), so that the rows of one text meet it in ``SALTS`` places. Of rows that
    repeat the kept doc_id and text one is kept.
    """
    keys = groups.select("digest", "keep_id", "group_size", "known", F.explode("salts").alias("salt"))
    again = F.row_number().over(Window.partitionBy("digest", "salt").orderBy(F.col("doc_id").desc()))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")
    return rows.join(keys, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (stays & (again == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_unique(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; all columns of ``docs`` and no others, whatever their names.

    A text keeps its row with the largest doc_id; of several rows with that doc_id and text the one that
    comes first in an order by hash of all columns. A text that has no doc_id at all keeps one row. With
    an ``index`` texts that it knew before are dropped, unless a table of the same name ``batch``
    brought them. Null texts count as empty; an empty table stays empty.
    """
    _, groups = deduplicate_table(docs, index, batch)
    digest, own, none, row, order = (free_name(docs, n) for n in ("digest", "own", "none", "row", "order"))
    key = lambda c: {own: F.coalesce(F.col(c).cast("bigint"), F.lit(0)), none: F.col(c).isNull()}
    kept = groups.filter(~F.col("known")).withColumns(key("keep_id")).select(F.col("digest").alias(digest), own, none)
    marked = docs.select(F.struct(*map(quoted, docs.columns)).alias(row), _digest().alias(digest), row_hash(docs).alias(order), *(c.alias(n) for n, c in key("doc_id").items()))
    # no key is null, so that the join's exchange and sort serve the aggregation too
    one = marked.join(kept, [digest, own, none], "left_semi").groupBy(digest, own, none).agg(F.min_by(row, order).alias(row))
    return one.select(*(F.col(row).getField(c).alias(c) for c in docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decide(*deduplicate_table(docs))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
