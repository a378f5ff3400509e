"""Command line: python -m quillon.cli {fetch,backtest,optimize,train,shadow} ..."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.meta import MetaModel
from quillon.params import interval, load_overrides
from quillon.plans import research
from quillon.session import session
from quillon.sources import bars as B
from quillon.streaming import live, shadow


def _bars(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return B.clean(B.read_bars(spark, args.bars, args.symbols or None))


def _settings(args: argparse.Namespace) -> research.Settings:
    return research.Settings().with_overrides(load_overrides(args.params) if args.params else {})


def fetch(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ticks (symbol, ts, price, volume, turnover, tie) in Parquet to the bar cache."""
    B.append_bars(B.time_bars(spark.read.parquet(args.ticks), interval(args.interval)), args.bars)


def backtest(spark: SparkSession, args: argparse.Namespace) -> None:
    model = MetaModel.load(args.model) if args.model else None
    out = research.backtest_plan(_bars(spark, args), _settings(args), model)
    out["stats"].show(truncate=False)
    out["trades"].write.mode("overwrite").csv(f"{args.out}/trades", header=True)
    out["equity"].write.mode("overwrite").csv(f"{args.out}/equity", header=True)


def optimize(spark: SparkSession, args: argparse.Namespace) -> None:
    trials = research.search(spark, _bars(spark, args), args.trials, args.seed)
    best = research.best_trials(trials, args.trials)
    best.write.mode("overwrite").json(f"{args.out}/best")
    first = best.first()
    print(json.dumps({"best_params": json.loads(first["params"]), "best_value": first["value"]}, indent=2))


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    research.train_meta(_bars(spark, args), _settings(args)).save(args.out)


def shadow_loop(spark: SparkSession, args: argparse.Namespace) -> None:
    """Adds the bars of new tick files to the cache and appends paper fills to the ledger; places no orders."""
    schema = "symbol string, ts timestamp, price double, volume double, turnover double, tie bigint"
    bars = live.streaming_bars(spark.readStream.schema(schema).parquet(args.ticks), interval(args.interval))
    model = MetaModel.load(args.model) if args.model else None
    settings = _settings(args)
    shadow.shadow_ledger(bars, args.bars, f"{args.out}/ledger", f"{args.out}/checkpoint", settings, model, once=args.once).awaitTermination()


COMMANDS = {f.__name__: f for f in (fetch, backtest, optimize, train, shadow_loop)}
log = logging.getLogger("quillon")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon")
    commands = out.add_subparsers(required=True, dest="command")
    for name, run in COMMANDS.items():
        p = commands.add_parser(name.removesuffix("_loop"), help=run.__doc__)
        p.set_defaults(run=name)
        p.add_argument("--bars", help="bar cache")
        p.add_argument("--ticks")
        p.add_argument("--symbols", nargs="*")
        p.add_argument("--interval", default="5")
        p.add_argument("--params", help="JSON of tuned parameters, flat or under best_params")
        p.add_argument("--model")
        p.add_argument("--trials", type=int, default=20)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--once", action="store_true")
        p.add_argument("--out")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.run](session("quillon"), args)


def dispatch(env: Mapping[str, str] = os.environ) -> int:
    """Runs the command that RUN_MODE names, with its options from QUILLON_BARS, QUILLON_TICKS and so on, for containers: exit code
    0, 1 after an error, 2 for an unknown mode, 130 when interrupted."""
    mode = env.get("RUN_MODE", "").strip().lower()
    known = [n.removesuffix("_loop") for n in COMMANDS]
    if mode not in known:
        log.error("unknown RUN_MODE %r; known: %s", mode, ", ".join(known))
        return 2
    argv = [mode, *(["--once"] if env.get("QUILLON_ONCE", "").lower() in ("1", "true", "yes") else [])]
    for name in ("bars", "ticks", "interval", "params", "model", "trials", "seed", "out"):
        if value := env.get(f"QUILLON_{name.upper()}"):
            argv += [f"--{name}", value]
    if symbols := [s.strip().upper() for s in env.get("QUILLON_SYMBOLS", "").split(",") if s.strip()]:
        argv += ["--symbols", *symbols]
    try:
        main(argv)
    except KeyboardInterrupt:
        log.warning("interrupted")
        return 130
    except Exception:  # noqa: BLE001  the exit code says so
        log.exception("%s failed", mode)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(dispatch() if len(sys.argv) == 1 and "RUN_MODE" in os.environ else main())
