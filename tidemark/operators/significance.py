"""Significance of profit factors: bootstrap intervals and a baseline of random entries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouped_stream import whole_groups
from tidemark.operators.metrics import CAP, profit_factor
from tidemark.schema import SESSION_END

MODULUS, SHIFT = 2_147_483_647, 48_271
#: Trades of a group that one task resamples; larger groups are dealt to blocks of about so many.
BLOCK_TRADES = 20_000
#: Draws made at once.
CELLS = 2_000_000
SHARE = "`__block` long, win array<double>, loss array<double>"


def draw(resample: np.ndarray, place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A reproducible pseudo-random number below n of (resample, place): four quadratic steps modulo a prime.

    Quadratic, as multiples alone would deal the places of a resample almost evenly.
    """
    x = (resample * 7919 + place * 104_729 + seed * 1_299_709 + 1) % MODULUS
    for _ in range(4):
        x = (x * (x + SHIFT) + resample) % MODULUS
    return x % n


def _factors(win: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss > 0, win / loss, np.where(win > 0, CAP, 0.0))


def _whole(tbl: pa.Table, keys: list[str], n_resamples: int, seed: int, low: float, high: float) -> pa.Table | None:
    """Intervals of complete groups, sorted by group and trade."""
    group = tbl.column("__group").to_numpy()
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    pnl = tbl.column("pnl").to_numpy()
    found = []
    for part in np.split(pnl, start[1:]):
        n, gain, cost = len(part), np.maximum(part, 0.0), np.maximum(-part, 0.0)
        win, loss = [], []
        step = max(1, CELLS // n)
        for a in range(0, n_resamples, step):
            r = np.arange(a, min(a + step, n_resamples), dtype=np.int64)[:, None]
            at = draw(r, np.arange(n, dtype=np.int64)[None, :], n, seed)
            win.append(gain[at].sum(1))
            loss.append(cost[at].sum(1))
        loss = np.concatenate(loss)
        pf = _factors(np.concatenate(win), loss)
        found.append((np.quantile(pf, low), np.quantile(pf, high), (loss <= 0).mean(), float(_factors(gain.sum(), cost.sum())), n))
    lower, upper, capped, own, n = zip(*found)
    cols = {"pf": own, "ci_lower": lower, "ci_upper": upper, "fraction_capped": capped}
    return pa.table({**{k: tbl.column(k).take(pa.array(start)) for k in keys}, **{k: np.array(v, float) for k, v in cols.items()}, "n_trades": np.array(n, np.int64)})


def draws_of_block(sizes: list[int], block: int, n_resamples: int, seed: list[int]) -> np.ndarray:
    """How many of a group's draws fall into one of its blocks, for each resample.

    The blocks are the leaves of a binary tree, and the draws at a node go left by a binomial whose generator is seeded
    by the node; so each block finds its own number alone, and over the blocks they add up to the draws of the group.
    """
    lo, hi = 0, len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    have = np.full(n_resamples, upto[-1], dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([*seed, lo, hi]).binomial(have, (upto[mid] - upto[lo]) / max(1, upto[hi] - upto[lo]))
        lo, hi, have = (lo, mid, left) if block < mid else (mid, hi, have - left)
    return have


def _share(tbl: pa.Table, n_resamples: int, seed: int) -> pa.Table | None:
    """Gains and losses that complete blocks of large groups bring to each resample."""
    key = tbl.column("__block").to_numpy()
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pnl, group = tbl.column("pnl").to_numpy(), tbl.column("__group").to_numpy()
    sizes, block = tbl.column("__sizes"), tbl.column("__own").to_numpy()
    wins, losses = [], []
    for a, part in zip(start, np.split(pnl, start[1:])):
        word = int(group[a])
        seeds = [seed, word & 0xFFFFFFFF, word >> 32 & 0xFFFFFFFF]
        take = draws_of_block(sizes[int(a)].as_py(), int(block[a]), n_resamples, seeds)
        rng = np.random.default_rng([*seeds, int(block[a]), 7])
        gain, cost = np.maximum(part, 0.0), np.maximum(-part, 0.0)
        win, loss = np.zeros(n_resamples), np.zeros(n_resamples)
        for r in range(n_resamples):
            at = rng.integers(0, len(part), take[r])
            win[r], loss[r] = gain[at].sum(), cost[at].sum()
        wins.append(win)
        losses.append(loss)
    return pa.table({"__block": key[start], "win": pa.array(wins, pa.list_(pa.float64())), "loss": pa.array(losses, pa.list_(pa.float64()))})


def bootstrap(
    trades: DataFrame, keys: list[str], n_resamples: int = 500, seed: int = 0, low: float = 0.05, high: float = 0.95, *, block_trades: int = BLOCK_TRADES
) -> DataFrame:
    """Profit factor of each group with percentiles over resamples with replacement, of as many draws as it has trades.

    Trades are shuffled once.  A group of up to ``block_trades`` is resampled by one task; a larger one is dealt to
    blocks, each of which draws its share of every resample, and only the shares (two numbers a block and resample)
    are added up.  Columns: the keys, pf, ci_lower, ci_upper, fraction_capped, n_trades, under_sampled.
    Groups without trades have no row; null keys are one group; trades of null pnl are left out.
    """
    d = trades.where("pnl is not null").select(*keys, "entry_ts", "exit_ts", F.col("pnl").cast("double").alias("pnl"), F.xxhash64(*keys).alias("__group"))
    key_ddl = ", ".join(f"`{k}` {trades.schema[k].dataType.simpleString()}" for k in keys)
    large = d.groupBy("__group").count().where(F.col("count") > block_trades)
    large = large.select("__group", F.ceil(F.col("count") / block_trades).cast("long").alias("__blocks"))
    result = f"{key_ddl}, pf double, ci_lower double, ci_upper double, fraction_capped double, n_trades long"
    order = ["entry_ts", "exit_ts", "pnl"]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(iter(batches), "__group", lambda t: _whole(t, keys, n_resamples, seed, low, high))

    small = d.join(large, "__group", "left_anti").repartition("__group").sortWithinPartitions("__group", *order)
    out = small.mapInArrow(whole, result)

    big = d.join(large, "__group").withColumn("__own", F.pmod(F.xxhash64(*order), F.col("__blocks")))
    counted = big.groupBy("__group", "__own").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__own", "n"))).alias("s"))  # one entry for block_trades trades
    places = sizes.select("__group", F.transform("s", lambda x: x["n"]).alias("__sizes"), F.posexplode("s").alias("__place", "x"))
    big = big.join(places.select("__group", F.col("x.__own").alias("__own"), F.col("__place"), "__sizes"), ["__group", "__own"])
    big = big.select("__group", "pnl", F.col("__place").cast("long").alias("__own"), "__sizes", F.xxhash64("__group", "__place").alias("__block"), *[c for c in order if c != "pnl"])

    def shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(iter(batches), "__block", lambda t: _share(t, n_resamples, seed))

    drawn = big.repartition("__block").sortWithinPartitions("__block", *order).mapInArrow(shares, SHARE)
    owner = places.select(F.xxhash64("__group", "__place").alias("__block"), "__group")
    drawn = drawn.join(owner, "__block").select("__group", F.posexplode(F.arrays_zip("win", "loss")).alias("r", "x"))
    sums = drawn.groupBy("__group", "r").agg(F.sum("x.win").alias("w"), F.sum("x.loss").alias("l"))
    pf = F.when(F.col("l") > 0, F.col("w") / F.nullif("l", F.lit(0.0))).when(F.col("w") > 0, CAP).otherwise(0.0)
    ci = sums.select("__group", pf.alias("b"), (F.col("l") <= 0).cast("double").alias("c")).groupBy("__group").agg(
        F.percentile("b", low).alias("ci_lower"), F.percentile("b", high).alias("ci_upper"), F.avg("c").alias("fraction_capped")
    )
    own = d.join(large, "__group", "left_semi").groupBy("__group", *keys).agg(profit_factor().alias("pf"), F.count("*").alias("n_trades"))
    out = out.unionByName(own.join(ci, "__group").select(*keys, "pf", "ci_lower", "ci_upper", "fraction_capped", "n_trades"))
    return out.withColumn("under_sampled", F.col("n_trades") < 100)


def bootstrap_numpy(pnl: np.ndarray, n_resamples: int = 5000, seed: int = 0, low: float = 0.05, high: float = 0.95) -> tuple[float, float, float]:
    """(lower, upper, fraction capped) of one group, drawn by numpy's generator in one stream, some rows at a time."""
    n = len(pnl)
    if n == 0:
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    win, loss = [], []
    step = max(1, CELLS // n)
    for a in range(0, n_resamples, step):
        x = pnl[rng.integers(0, n, size=(min(step, n_resamples - a), n))]
        win.append(np.maximum(x, 0.0).sum(1))
        loss.append(np.maximum(-x, 0.0).sum(1))
    loss = np.concatenate(loss)
    pf = _factors(np.concatenate(win), loss)
    return float(np.quantile(pf, low)), float(np.quantile(pf, high)), float((loss <= 0).mean())


def _outcomes(high: np.ndarray, low: np.ndarray, close: np.ndarray, stops: dict[int, float], rr: float, slippage: float, realistic: bool) -> np.ndarray:
    """P&L of an entry at each bar's close, for long (row 0) and short (row 1); NaN where there is no risk to take."""
    m = len(close)
    out = np.full((2, m), np.nan)
    later = np.arange(m)[None, :] > np.arange(m)[:, None]
    for row, sign in enumerate((1, -1)):
        entry = close + sign * slippage
        risk = (entry - stops[sign]) * sign
        worst, best = (low, high) if sign == 1 else (high, low)
        target = entry + sign * risk * rr
        stopped = (worst - stops[sign]) * sign <= 0
        reached = (best[None, :] - target[:, None]) * sign >= 0
        hit = later & (stopped[None, :] | reached)
        k = hit.argmax(1)
        some = hit.any(1)
        price = np.where(some, np.where(stopped[k], stops[sign], target), np.where(np.arange(m) < m - 1, close[-1], close))
        free = some & (not realistic)
        paid = price - np.where(free, 0.0, sign * slippage)
        out[row] = np.where(risk > 0, (paid - entry) * sign, np.nan)
    return out


def _session_trials(tbl: pa.Table, trials: int, seed: int, rr: float, slippage: float, realistic: bool) -> pa.Table | None:
    """Gains and losses per trial of each session, sorted by session and time.

    What an entry earns depends only on its bar and side, so it is worked out once and the trials only draw.
    """
    key = tbl.column("__session").to_numpy()
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    high, low, close = (tbl.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "close"))
    early = tbl.column("early").to_numpy(zero_copy_only=False).astype(bool)
    wanted = tbl.column("n_entries").to_numpy()
    sessions, wins, losses = [], [], []
    for a, z in zip(start, end):
        bars = np.arange(a + 1, z)[early[a + 1 : z]]
        if z - a < 2 or not len(bars):
            continue
        word = int(key[a])
        rng = np.random.default_rng([seed, word & 0xFFFFFFFF, word >> 32 & 0xFFFFFFFF])
        table = _outcomes(high[bars], low[bars], close[bars], {1: low[a], -1: high[a]}, rr, slippage, realistic)
        n = min(int(wanted[a]), len(bars))
        picks = rng.random((trials, len(bars))).argsort(axis=1)[:, :n]
        pnl = table[(rng.random((trials, n)) < 0.5).astype(int), picks]
        sessions.append(a)
        wins.append(np.nansum(np.maximum(pnl, 0), axis=1))
        losses.append(np.nansum(np.maximum(-pnl, 0), axis=1))
    if not sessions:
        return None
    return pa.table(
        {
            "symbol": tbl.column("symbol").take(pa.array(np.repeat(sessions, trials))),
            "trial": np.tile(np.arange(trials, dtype=np.int32), len(sessions)), "win": np.concatenate(wins), "loss": np.concatenate(losses),
        }
    )


def random_baseline(bars: DataFrame, trades: DataFrame, *, trials: int = 200, seed: int = 0, rr: float = 2.0, slippage: float = 0.01, realistic: bool = True) -> DataFrame:
    """(symbol, pf, p_value, median_baseline_pf, n_trials): how often random entries do as well.

    Each session has as many random entries as the strategy had, with the opening bar's
    range as stop and a target at ``rr`` times the risk.  Sessions are drawn apart, each with a
    generator seeded by the session, and added up per trial, so a symbol is never gathered.  A
    symbol without trades has p = 1; one bar per session allows no entry, so every trial is 0.
    """
    per = trades.groupBy("symbol", F.to_date("entry_ts").alias("day")).agg(F.count("*").alias("n_entries"))
    minute = SESSION_END.hour * 60 + SESSION_END.minute
    d = bars.withColumn("day", F.to_date("ts")).join(per, ["symbol", "day"]).select(
        "symbol", "ts", "high", "low", "close", "n_entries", (F.hour("ts") * 60 + F.minute("ts") < minute).alias("early"), F.xxhash64("symbol", "day").alias("__session")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(iter(batches), "__session", lambda t: _session_trials(t, trials, seed, rr, slippage, realistic))

    parts = d.repartition("__session").sortWithinPartitions("__session", "ts").mapInArrow(run, "symbol string, trial int, win double, loss double")
    sums = parts.groupBy("symbol", "trial").agg(F.sum("win").alias("w"), F.sum("loss").alias("l"))
    pfs = sums.select("symbol", F.when(F.col("l") > 0, F.col("w") / F.nullif("l", F.lit(0.0))).when(F.col("w") > 0, CAP).otherwise(0.0).alias("b"))
    own = trades.groupBy("symbol").agg(profit_factor().alias("pf"))
    b = pfs.join(own, "symbol").groupBy("symbol").agg(F.avg((F.col("b") >= F.col("pf")).cast("double")).alias("p"), F.median("b").alias("m"))
    base = bars.select("symbol").distinct().join(own, "symbol", "left").join(b, "symbol", "left")
    degenerate = F.col("p").isNull() & F.col("pf").isNotNull()
    return base.select(
        "symbol", F.coalesce("pf", F.lit(0.0)).alias("pf"),
        F.when(F.col("pf").isNull(), 1.0).when(degenerate, (F.col("pf") <= 0).cast("double")).otherwise(F.col("p")).alias("p_value"),
        F.coalesce("m", F.lit(0.0)).alias("median_baseline_pf"), F.lit(trials).alias("n_trials"), degenerate.alias("baseline_degenerate"),
    )
