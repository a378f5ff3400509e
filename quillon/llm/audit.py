"""How filters interact: what each one removes, and for which others it does the work, in every order.

Each document's failures are a bit mask. Documents are counted by part and mask; these cells, of which there
are at most 2^filters a part, are laid out against every step of every order. A running bit-or over an
order's steps tells which filters came earlier, so whether a cell's documents were still there; sums over
cells give a step's figures, and totals over a filter's rows its share over all orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table, workspace

#: A text's rows are dealt to so many tasks.
SALTS = 64
#: Orders grow as the factorial: 720 of 6 filters.
MOST_FILTERS = 6
#: The name of the filter that drops later copies of a text.
COPIES = "E"
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a document fails A to D, on a text that isn't null."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _flags(labels: DataFrame) -> DataFrame:
    """One row per labelled document: key, good and toxic, if any of its labels says so."""
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("bigint")
    keyed = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("key"))
    return keyed.agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str | None = COPIES) -> DataFrame:
    """One row per document: doc_id, part (its lang; null: empty), mask, good, toxic. Bit i of the mask is set if the
    document fails the i-th of ``filters`` (name to condition, A to D by default; on the columns of ``docs``, and
    unknown conditions hold for none), and the last bit, unless ``copies`` is None, if its text is that of a smaller doc_id.

    Null texts count as empty. Rows without a doc_id are nobody's original and no copies, and have no labels; rows
    that repeat a doc_id and text are no copies of each other. A document counts as labelled if any of its labels says so.
    """
    spark = docs.sparkSession
    at = workspace(spark, "failures")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filters = text_filters(text) if filters is None else filters
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        sum(bits, F.lit(0)).cast("int").alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = materialize(rows, f"{at}/rows")
    if copies is not None:
        by_salt = rows.groupBy("digest", "salt").agg(F.min("key").alias("first"), F.count("key").alias("n"))
        texts = by_salt.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
        repeated = texts.filter("n > 1").select("digest", "first", F.explode("salts").alias("salt"))
        copy = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
        marked = F.col("mask") + F.when(copy, F.lit(1 << len(bits))).otherwise(F.lit(0))
        rows = rows.join(repeated, ["digest", "salt"], "left").select("key", "part", marked.alias("mask"))
    flagged = rows.join(_flags(labels), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return flagged.select(F.col("key").alias("doc_id"), "part", "mask", zero("good"), zero("toxic"))


def cells(failed: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask."""
    return failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(of_parts: DataFrame, names: list[str]) -> DataFrame:
    """For every part of the cells (part, mask, n, good, toxic), every order of ``names`` (bit i of a mask is
    names[i]) and every step, zeros included: part, filter_order, step, filter; documents kept after
    it, removed by it, redundant (failing it, removed earlier), unique_fails (failing it only), good_lost and toxic_lost
    (removed by it), and shapley, what this filter removes in all orders together. Parts without cells have no rows."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} different filters are needed")
    n = len(names)
    orders = F.array(*(F.array(*map(F.lit, p)) for p in permutations(range(n))))
    spread = of_parts.select("*", F.explode(orders).alias("order"))
    long = spread.select("part", "mask", "n", "good", "toxic", "order", F.posexplode("order").alias("at", "of"))
    long = long.withColumn("bit", F.expr("shiftleft(1, of)"))
    along = Window.partitionBy("part", "mask", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(along), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda c, x="n": F.sum(F.when(c, F.col(x)).otherwise(0)).cast("bigint")
    steps = long.groupBy("part", "order", "at", "of").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "of"))
    name = lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    return steps.select(
        "part",
        F.array_join(F.transform("order", name), "").alias("filter_order"),
        (F.col("at") + 1).cast("int").alias("step"),
        name(F.col("of")).alias("filter"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str | None = COPIES) -> DataFrame:
    """``interactions`` of ``failures``. An empty table gives no rows; columns of ``docs`` other than doc_id, text and lang
    matter only to ``filters``."""
    names = [*(text_filters(F.lit("")) if filters is None else filters), *([] if copies is None else [copies])]
    counted = cells(failures(docs, labels, filters, copies))
    return interactions(materialize(counted, workspace(docs.sparkSession, "cells")), names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels")).drop("filter")


OP11_SQL = r"""
WITH f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c.l) JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), s AS (
  SELECT o.filter_order, i AS step, (SELECT b FROM f WHERE l = filter_order[i]) AS bit,
         (SELECT coalesce(sum(b), 0) FROM f WHERE contains(filter_order[1:i - 1], l)) AS earlier
  FROM o, range(1, 6) r(i)
), t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
m AS (
  SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask
  FROM w
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL
), g AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM g
"""
