"""Long series in blocks of time, so that no task needs all rows of a symbol.

Rows are range-partitioned by (symbol, order), counted by part and numbered by prefix sums of the counts;
blocks are then whole numbers of rows. Bounded frames run over a block with a halo of the rows before
it; recursions are scanned in three passes: each block's summary, a composition over the few summaries of a
symbol, and a fill with the state that a block begins in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.scans import Scan
from quillon.storage import stage

#: Rows of a block: some 50 MB with the columns of a feature matrix.
ROWS = 100_000
PART, NUMBER, BLOCK, SYMBOL = "__part", "__n", "__block", "__symbol"


def in_parts(df: DataFrame, *order: str) -> DataFrame:
    """``df``, written, with __part: parts follow each other in the order of symbol and ``order``; equal keys share one."""
    return stage(df.repartitionByRange("symbol", *order).withColumn(PART, F.spark_partition_id()), "parts")


def before_parts(parts: DataFrame, *sums: Column) -> DataFrame:
    """(symbol, __part, ...): each of ``sums`` over the symbol's earlier parts. One row for each symbol and part."""
    names = [f"__before{i}" for i in range(len(sums))]
    own = parts.groupBy("symbol", PART).agg(*(s.alias(n) for s, n in zip(sums, names, strict=True)))
    earlier = Window.partitionBy("symbol").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return own.select("symbol", PART, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names))


@dataclass(frozen=True)
class Blocks:
    """``df`` with __n, the number of a row in its symbol, and __block = __n div rows."""

    df: DataFrame
    rows: int

    @classmethod
    def of(cls, df: DataFrame, rows: int = ROWS, order: tuple[str, ...] = ("ts",)) -> "Blocks":
        """Rows of ``df`` (symbol, ...) in the order of ``order``; columns that begin with two underscores are the class's own."""
        if rows < 1:
            raise ValueError("a block has at least one row")
        parts = in_parts(df, *order)
        at = F.row_number().over(Window.partitionBy("symbol", PART).orderBy(*order)) - 1
        numbered = parts.withColumn(NUMBER, at).join(before_parts(parts, F.count(F.lit(1))), ["symbol", PART])
        number = F.col(NUMBER) + F.col("__before0")
        numbered = numbered.select(*df.columns, number.cast("bigint").alias(NUMBER), F.floor(number / rows).cast("bigint").alias(BLOCK))
        return cls(stage(numbered, "blocks"), rows)

    def with_columns(self, columns: Mapping[str, Column]) -> "Blocks":
        """Columns that depend on their own row only."""
        return replace(self, df=self.df.withColumns(dict(columns)))

    def windows(self, halo: int, f: Callable[[DataFrame], DataFrame]) -> "Blocks":
        """``f`` adds columns with frames that reach back at most ``halo`` rows in all; it sees each block, with that
        many rows before it, as a symbol of its own."""
        if not 0 <= halo <= self.rows:
            raise ValueError(f"a halo of {halo} rows doesn't fit in blocks of {self.rows}")
        own = self.df.withColumn("__halo", F.lit(False))
        behind = self.df.filter(F.col(NUMBER) % self.rows >= self.rows - halo)
        behind = behind.withColumns({BLOCK: F.col(BLOCK) + 1, "__halo": F.lit(True)})
        rows = own.unionByName(behind).withColumnRenamed("symbol", SYMBOL)
        # a separator that doesn't matter: the block's number has no other characters behind the last one
        out = f(rows.withColumn("symbol", F.concat_ws("/", SYMBOL, BLOCK)))
        return replace(self, df=out.filter(~F.col("__halo")).drop("symbol", "__halo").withColumnRenamed(SYMBOL, "symbol"))

    def scan(self, scans: Mapping[str, tuple[str, Scan]]) -> "Blocks":
        """Columns of recursions: name to (input column, scan)."""
        df, specs = stage(self.df, "scanned"), dict(scans)
        inputs = list(dict.fromkeys(c for c, _ in specs.values()))
        narrow = df.select("symbol", BLOCK, NUMBER, *inputs)

        def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(NUMBER)
            sums = [s.summary(pdf[c].to_numpy(float)) for c, s in specs.values()]
            return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], BLOCK: [pdf[BLOCK].iloc[0]], "sums": [sums]})

        def compose(pdf: pd.DataFrame) -> pd.DataFrame:
            states = [s.start() for _, s in specs.values()]
            out = []
            pdf = pdf.sort_values(BLOCK)
            for sums in pdf["sums"]:
                out.append(states)
                states = [s.after(state, list(own)) for (_, s), state, own in zip(specs.values(), states, sums, strict=True)]
            return pd.DataFrame({"symbol": pdf["symbol"], BLOCK: pdf[BLOCK], "states": out})

        symbol = df.schema["symbol"].dataType.simpleString()
        sums = narrow.groupBy("symbol", BLOCK).applyInPandas(summarise, f"symbol {symbol}, {BLOCK} bigint, sums array<array<double>>")
        # one row a block: 10,000 of them for 10^9 rows
        states = sums.groupBy("symbol").applyInPandas(compose, f"symbol {symbol}, {BLOCK} bigint, states array<array<double>>")
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in specs)])

        def fill(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(NUMBER, ignore_index=True)
            begin = state["states"].iloc[0]
            return pdf.assign(**{n: s.run(pdf[c].to_numpy(float), list(b)) for (n, (c, s)), b in zip(specs.items(), begin, strict=True)})[schema.names]

        by = ("symbol", BLOCK)
        return replace(self, df=df.groupBy(*by).cogroup(states.groupBy(*by)).applyInPandas(fill, schema))

    def bars(self) -> DataFrame:
        """The rows without the class's own columns."""
        return self.df.drop(NUMBER, BLOCK)


def pct_ranks(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``x`` among all values of its symbol as a share, ties at their mean rank; NULL for NULL.

    Distinct values are counted first, so that neither a symbol nor a common value meets in one task; then
    they are ordered in parts, and counts of earlier parts and of earlier values of the part are added.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy("symbol", x).agg(F.count(F.lit(1)).alias("__ties"))
    parts = in_parts(counts, x)
    earlier = Window.partitionBy("symbol", PART).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    total = parts.groupBy("symbol").agg(F.sum("__ties").alias("__total"))
    ranked = parts.withColumn("__below", F.coalesce(F.sum("__ties").over(earlier), F.lit(0)))
    ranked = ranked.join(before_parts(parts, F.sum("__ties")), ["symbol", PART]).join(total, "symbol")
    share = (F.col("__before0") + F.col("__below") + (F.col("__ties") + 1) / F.lit(2.0)) / F.col("__total")
    return df.join(ranked.select("symbol", x, share.alias(name)), ["symbol", x], "left").select(*df.columns, name)


