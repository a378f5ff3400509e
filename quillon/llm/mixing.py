"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget goes down the tree in proportion to weights. A node that can't use its share (tokens
times the most epochs) gives the rest to its siblings in proportion to their weights; only what all
siblings can't use reaches the level above, since a parent's capacity is the sum of its children's.
Each leaf then takes whole epochs and, of one more epoch, the documents of a seeded order as long as
their tokens fit. All amounts are whole numbers, rounded down at each node.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import free_name, materialize, quoted, workspace

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by node name; nodes that aren't named weigh ``default``; 0 takes nothing."""

    domain_of: str = "CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END"
    domains: Mapping[str, int] = field(default_factory=lambda: {"crawl": 3, "curated": 7})
    languages: Mapping[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    sources: Mapping[str, int] = field(default_factory=dict)
    default: int = 1
    #: Percentage of the table's tokens to be handed out, and the most epochs of a document.
    budget_percent: int = 100
    max_epochs: int = 3
    seed: str = "mix-1"


def tokens_of(text: Column) -> Column:
    """An estimate that needs no tokenizer: a token for each 4 bytes begun, at least one."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint") + 1


def _weight(name: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("bigint")


def fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent keys, child, weight, cap, budget of the parent) with ``share``, whole tokens.

    In the order of cap/weight a node is full if the budget left per remaining weight covers it; the
    nodes that aren't full divide what is left by weight.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    live = F.col("weight") > 0
    order = Window.partitionBy(*parent).orderBy(F.when(live, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col(child))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    step = nodes.withColumn("before", before).withColumn("after", after)
    full = live & (big("cap") * big("after") <= (F.col("budget") - F.col("before")).cast("decimal(19,0)") * big("weight"))
    step = step.withColumn("full", full)
    whole = Window.partitionBy(*parent)
    step = step.withColumn(
        "left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    ).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    part = F.expr("CASE WHEN weight > 0 THEN (CAST(left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0))) div open ELSE 0L END")
    return step.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).select(
        *parent, child, "cap", F.col("share").cast("bigint").alias("share")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``share``: each leaf's tokens to select."""
    cap = (F.col("tokens") * mix.max_epochs).alias("cap")
    leaf = leaves.select(*LEAF, cap)
    language = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domain = language.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = domain.select(F.lit(0).alias("root"), "domain", "cap", _weight(F.col("domain"), mix.domains, mix.default).alias("weight"))
    capacity = F.sum("cap").over(Window.partitionBy("root"))
    percent = f"capacity div {mix.max_epochs} * {mix.budget_percent} div 100"
    top = fill(top.withColumn("capacity", capacity).withColumn("budget", F.expr(percent)), ["root"], "domain")
    mid = language.join(top.select("domain", F.col("share").alias("budget")), "domain")
    mid = fill(mid.withColumn("weight", _weight(F.col("lang"), mix.languages, mix.default)), ["domain"], "lang")
    low = leaf.join(mid.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return fill(low.withColumn("weight", _weight(F.col("source"), mix.sources, mix.default)), ["domain", "lang"], "source")


def select(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per selected document and epoch: doc_id, domain, lang, source, tokens, epoch.

    Null texts weigh one token; null languages and sources count as ''. Repeated rows are documents
    of their own. An empty table selects nothing. A leaf's last epoch is cut by bucket sums: buckets
    (the first three digits of the order key) that fit are taken whole, and only the one bucket where
    the budget ends is sorted.
    """
    at = workspace(docs.sparkSession, "mix")
    named = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        tokens_of(F.col("text")).alias("tokens"),
    )
    rows = materialize(named.withColumn("domain", F.expr(mix.domain_of)), f"{at}/rows")
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, mix).withColumn("size", (F.col("cap") / mix.max_epochs).cast("bigint"))
    plan = plan.select(*LEAF, F.expr("share div size").alias("whole"), F.expr("share % size").alias("rest"))
    plan = materialize(plan, f"{at}/plan")
    key = F.md5(F.concat_ws("-", F.lit(mix.seed), F.col("whole"), F.col("doc_id")).cast("binary"))
    keyed = rows.join(plan, LEAF).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    keyed = materialize(keyed, f"{at}/keyed")
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*LEAF).agg(
        F.min("bucket").alias("last"), F.min("upto").alias("upto"), F.min_by("tokens", "bucket").alias("in_last")
    )
    ends = materialize(ends.select(*LEAF, "last", (F.col("upto") - F.col("in_last")).alias("base")), f"{at}/ends")
    cut = keyed.join(ends, LEAF, "left")
    order = Window.partitionBy(*LEAF).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = cut.filter(F.col("bucket") == F.col("last")).withColumn("sum", F.col("base") + F.sum("tokens").over(order))
    out = ["doc_id", *LEAF, "tokens", "whole"]
    extra = cut.filter("last IS NULL OR bucket < last").select(*out).unionByName(edge.filter("sum <= rest").select(*out))
    again = keyed.select(*out, F.explode(F.expr("CASE WHEN whole > 0 THEN sequence(0L, whole - 1) END")).alias("epoch"))
    chosen = again.unionByName(extra.withColumn("epoch", F.col("whole")))
    return chosen.select("doc_id", *LEAF, "tokens", F.col("epoch").cast("int").alias("epoch"))


def keep_mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` that ``select`` chose, one for each epoch that takes them; no other columns.

    Rows with the same doc_id, leaf and tokens are alike to the budget: of them as many are taken as
    were chosen, in an order by hash of their texts. All rows without a doc_id in one leaf and of one
    size meet in one task. Columns may have any names; an empty table stays empty.
    """
    like = {
        "doc_id": F.col("doc_id").cast("bigint"),
        "lang": F.coalesce(F.col("lang"), F.lit("")),
        "source": F.coalesce(F.col("source"), F.lit("")),
        "tokens": tokens_of(F.col("text")),
    }
    names = {c: free_name(docs, c) for c in like}
    none, rank, times, again = (free_name(docs, x) for x in ("none", "rank", "times", "again"))
    each = select(docs, mix).groupBy("doc_id", "lang", "source", "tokens", "epoch").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("doc_id", "lang", "source", "tokens").agg(F.collect_list("n").alias(times))
    id_of = F.coalesce(F.col("doc_id"), F.lit(0))
    keys = [*names.values(), none]
    chosen = each.select(
        id_of.cast("bigint").alias(names["doc_id"]), *(F.col(c).alias(names[c]) for c in list(like)[1:]), F.col("doc_id").isNull().alias(none), times
    )
    marked = docs.withColumns({names[c]: x for c, x in like.items()})
    marked = marked.withColumn(none, F.col(names["doc_id"]).isNull()).withColumn(names["doc_id"], F.coalesce(names["doc_id"], F.lit(0).cast("bigint")))
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("text"), "text")
    joined = marked.join(chosen, keys).withColumn(rank, F.row_number().over(order))
    taken = F.size(F.filter(F.col(times), lambda n: n >= F.col(rank)))
    copies = F.explode(F.when(taken > 0, F.sequence(F.lit(1), taken)))
    return joined.select(*map(quoted, docs.columns), copies.alias(again)).drop(again)


MIX = Mix()


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return select(docs, MIX)


def _fill_sql(name: str, nodes: str, parent: str, child: str) -> str:
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft
  FROM ({nodes})
), {name}_b AS (SELECT *, cap * aft <= (budget - bef) * weight AS full_ FROM {name}_a),
{name} AS (
  SELECT *, CASE WHEN full_ THEN cap ELSE
    ((budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent})) * weight)
    // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) END AS share
  FROM {name}_b
)"""


OP4_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, strlen(coalesce(text, '')) // 4 + 1 AS tokens,
         CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain
  FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(tokens) * 3 AS HUGEINT) AS cap FROM r GROUP BY ALL),
lang_ AS (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap FROM leaf GROUP BY ALL),
dom_ AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap FROM lang_ GROUP BY ALL),
{_fill_sql("top", "SELECT 0 AS root, *, CAST(CASE domain WHEN 'crawl' THEN 3 ELSE 7 END AS HUGEINT) AS weight, (SELECT sum(tokens) FROM r) AS budget FROM dom_", "root", "domain")},
{_fill_sql("mid", "SELECT l.*, CAST(CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 1 END AS HUGEINT) AS weight, t.share AS budget FROM lang_ l JOIN top t USING (domain)", "domain", "lang")},
{_fill_sql("low", "SELECT f.*, CAST(1 AS HUGEINT) AS weight, m.share AS budget FROM leaf f JOIN mid m USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, share // (cap // 3) AS whole, share % (cap // 3) AS rest FROM low),
k AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1-' || whole || '-' || doc_id), doc_id, tokens
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch
FROM k
"""
