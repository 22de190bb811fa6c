"""The whole evaluation of a signal strategy: walk-forward, significance, score and thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.functions.dsl import Spec
from tidemark.functions.indicators import add_indicators, over_long_series
from tidemark.operators import scoring, significance, walkforward
from tidemark.operators.backtest import BacktestConfig
from tidemark.session import cut
from tidemark.sources.bars import optimization_mode


@dataclass(frozen=True)
class EvaluationConfig:
    walk: walkforward.WalkForwardConfig = walkforward.WalkForwardConfig()
    backtest: BacktestConfig = BacktestConfig()
    n_bootstrap: int = 5000
    m_baseline: int = 200
    seed: int = 0
    #: reported scores are 0 below so many trades; 0 for none
    trade_floor: int = 0


#: The quick variant: fewer draws, and no score for few trades.
FAST = EvaluationConfig(n_bootstrap=500, m_baseline=20, trade_floor=50)


def evaluate(bars: DataFrame, spec: Spec, grid: dict[str, list[Any]] | None = None, config: EvaluationConfig = EvaluationConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, per symbol, windows) of a strategy over the bars of all symbols at once.

    The bars must end before the holdout; while the search runs, holdout data cannot be loaded.  A symbol
    without out-of-sample trades has a row with profit factor 0, and counts in no median and no spread.
    """
    bars = cut(bars)
    with optimization_mode():
        report, oos = walkforward.walk_forward(bars, spec, grid, config.walk, config.backtest)
    summary, per = conclude(bars, oos, spec, len(grid or {}), config)
    return summary, per, report


def evaluate_holdout(bars: DataFrame, boundary: Any, spec: Spec, config: EvaluationConfig = EvaluationConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, per symbol, trades) of a strategy with its default parameters on the bars from ``boundary`` on.

    Bars before it only warm the strategy up; the random baseline enters on the holdout's own bars.
    """
    bars = cut(bars)
    trades = cut(walkforward.holdout_run(bars, boundary, spec, config.backtest, config.walk.warmup_bars))
    held = bars.where(F.col("ts") >= F.lit(boundary).cast("timestamp_ntz"))
    summary, per = conclude(held, trades, spec, 0, config)
    return summary, per, trades


def conclude(bars: DataFrame, trades: DataFrame, spec: Spec, n_grid: int, config: EvaluationConfig) -> tuple[DataFrame, DataFrame]:
    """(summary, per symbol) from the trades that count: intervals, baseline, score and thresholds, the same for every kind of evaluation."""
    boot = significance.bootstrap(trades, ["symbol"], config.n_bootstrap, config.seed)
    base = significance.random_baseline(bars, trades, trials=config.m_baseline, seed=config.seed, slippage=config.backtest.slippage, realistic=config.backtest.realistic_fills)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    per = base.drop("pf").join(boot, "symbol", "left").select(
        "symbol", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), zero("pf"), zero("ci_lower"), zero("ci_upper"), zero("fraction_capped"),
        "p_value", "median_baseline_pf", "baseline_degenerate", F.coalesce("under_sampled", F.lit(True)).alias("under_sampled"),
    )
    per = cut(per).withColumn("strategy", F.lit(spec.name))
    summary = scoring.robustness(scoring.aggregate_symbols(per, ["strategy"]), n_grid)
    summary = scoring.fast_floor(scoring.failed_gates(summary), config.trade_floor)
    return summary.join(scoring.basket_hash(per, ["strategy"]), "strategy"), per.drop("strategy")


def diagnose(bars: DataFrame, spec: Spec, n_trades: int, backtest: BacktestConfig, *, below: int = 10) -> DataFrame | None:
    """How often each entry of a strategy that hardly trades is met, per symbol and clause; None from ``below`` trades on."""
    if n_trades >= below:
        return None
    ready = add_indicators(bars.withColumn("session", F.to_date("ts")), ["symbol", "session"], spec.indicators) if backtest.sessions else over_long_series(bars, spec.indicators)
    parts = [dsl.signal_frequency(ready, spec, slot).withColumn("slot", F.lit(slot)) for slot in ("entry_long", "entry_short") if spec.doc[slot] is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
