"""The meta model: boosted trees that say how likely a signal is to reach its target."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import boosting
from quillon.params import MetaParams
from quillon.storage import stage


@dataclass(frozen=True)
class MetaModel:
    features: tuple[str, ...]
    #: A row for each node (boosting.TREES).
    trees: pd.DataFrame
    params: MetaParams

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with prob, NULL where a feature is. A missing feature is an error."""
        if missing := [c for c in self.features if c not in df.columns]:
            raise KeyError(f"missing features: {missing[:5]}")
        margin = boosting.margins(self.trees)(F.array(*(F.col(f"`{c}`").cast("double") for c in self.features)))
        return df.withColumn("prob", 1 / (1 + F.exp(-margin)))

    def filter_signals(self, df: DataFrame, threshold: float | None = None, side: str = "side") -> DataFrame:
        """Rows with a side, with prob and take."""
        least = self.params.threshold if threshold is None else threshold
        return self.probabilities(df.filter(F.col(side) != 0)).withColumn("take", F.col("prob") >= least)

    def save(self, path: str) -> None:
        """Two small tables below ``path``: the trees, and features and parameters as JSON."""
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.trees.astype(object).where(self.trees.notna(), None), boosting.TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        told = json.dumps({"features": self.features, "params": asdict(self.params)})
        spark.createDataFrame([(told,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str, params: MetaParams | None = None) -> "MetaModel":
        spark = SparkSession.getActiveSession()
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(tuple(about["features"]), spark.read.parquet(f"{path}/trees").toPandas(), params or MetaParams(**about["params"]))


def fit(train: DataFrame, features: list[str], params: MetaParams | None = None, label: str = "y") -> MetaModel:
    """Fits on rows with all features and the label 0 or 1; both kinds weigh the same in total, so that trees begin
    from even chances. Rows of one kind only, or none, are an error."""
    p = params or MetaParams()
    names = [f"f{i}" for i in range(len(features))]
    columns = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names, strict=True)]
    rows = stage(train.select(*columns, F.col(label).cast("double").alias("__y")).na.drop(), "training")
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    if not counts:
        raise ValueError("no training rows: there are no labelled events")
    if len(counts) < 2:
        raise ValueError(f"training labels are all {int(next(iter(counts)))}; both kinds are needed")
    total = sum(counts.values())
    weight = F.when(F.col("__y") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    trees = boosting.train(rows.withColumn("__weight", weight), names, "__y", "__weight", p, total)
    return MetaModel(tuple(features), trees, p)
