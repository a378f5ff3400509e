"""URL filters (DataFrame operations only): host and path rules, and gradient-boosted trees on lexical
features for the URLs that no rule fits. The trees learn from the URLs that rules label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, workspace

#: The trees are fitted on about so many labelled rows at most, chosen by a hash of page_id.
MAX_TRAIN = 200_000
#: Suffixes are counted in so many hash buckets, which bounds the table that is broadcast. Suffixes that
#: share a bucket share their statistics: with 1,500 suffixes in use a rare one likely takes a common one's.
SUFFIX_BUCKETS = 1024
FEATURES = (
    "url_length", "host_length", "host_labels", "path_depth", "digit_ratio", "entropy", "parameters", "hyphens",
    "has_fragment", "is_https", "suffix_length", "suffix_log_count", "suffix_block_rate",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, url.substr(begin + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def match(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule,verdict> of the longest rule that fits, else null. ``rules`` is a short fixed list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character of a string's own character distribution; 0 for an empty one."""
    chars = F.split(text, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(pages: DataFrame) -> DataFrame:
    """Host, path, suffix bucket and the features that need no other row. Null urls count as empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = split_url(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    df = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"), query.alias("query"))
    suffix = F.substring_index("host", ".", -1)
    length = F.length("url").cast("double")
    return df.select(
        "page_id",
        "host",
        "path",
        match(F.col("host"), F.col("path")).alias("ruled"),
        F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_BUCKETS)).alias("bucket"),
        length.alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("host", F.lit(r"\.")).cast("double").alias("host_labels"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        F.when(length > 0, F.regexp_count("url", F.lit("[0-9]")) / length).otherwise(0.0).alias("digit_ratio"),
        F.when(length > 0, _entropy(F.col("url"))).otherwise(0.0).alias("entropy"),
        F.regexp_count("query", F.lit("[^&]+")).cast("double").alias("parameters"),
        F.regexp_count("url", F.lit("-")).cast("double").alias("hyphens"),
        F.contains("url", F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith("url", F.lit("https:")).cast("double").alias("is_https"),
        F.length(suffix).cast("double").alias("suffix_length"),
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """bucket, suffix_log_count and how many of its urls rules label and block: at most SUFFIX_BUCKETS rows."""
    return rows.groupBy("bucket").agg(
        F.log1p(F.count(F.lit(1))).alias("suffix_log_count"),
        F.count("ruled.verdict").alias("labelled"),
        F.sum(F.when(F.col("ruled.verdict") == "block", 1).otherwise(0)).alias("blocked"),
    )


def with_suffixes(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with suffix_log_count and suffix_block_rate, the smoothed share of the *other* labelled
    urls of the bucket that are blocked: a url's own label is left out of its features."""
    own = F.when(F.col("ruled").isNotNull(), 1).otherwise(0)
    own_block = F.when(F.col("ruled.verdict") == "block", 1).otherwise(0)
    rate = (F.col("blocked") - own_block + 1) / (F.col("labelled") - own + 2)
    return rows.join(F.broadcast(stats), "bucket").withColumn("suffix_block_rate", rate).drop("labelled", "blocked")


def training_rows(rows: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame | None:
    """FEATURES and label of about ``max_train`` of the rows that rules label, chosen by a hash of page_id
    and written once, since every boosting pass reads them; None if labels aren't of both kinds."""
    labelled = rows.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled.verdict") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return None
    if n > max_train:
        labelled = labelled.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    return materialize(labelled.select(*FEATURES, "label"), workspace(rows.sparkSession, "url_labels"))


def fit(rows: DataFrame, max_train: int = MAX_TRAIN, rounds: int = 12, depth: int = 4) -> GBTClassificationModel | None:
    """Trees for "blocked" from the rows that rules label; None if these aren't of both kinds."""
    some = training_rows(rows, max_train)
    if some is None or some.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(some).select("features", "label")
    return GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(data)


def judge(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row; rules first, else the trees.

    Repeated rows are judged alike and null page_ids like others; null urls count as empty. Without labelled rows of both kinds, urls that no rule fits are
    allowed with a null score. An empty table gives no rows.
    """
    spark = pages.sparkSession
    at = workspace(spark, "urls")
    rows = materialize(lexical(pages), f"{at}/lexical")
    stats = materialize(suffix_statistics(rows), f"{at}/suffixes")
    rows = with_suffixes(rows, stats)
    model = fit(rows)
    if model is None:
        scored = rows.withColumn("block_score", F.lit(None).cast("double"))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "block_score"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
