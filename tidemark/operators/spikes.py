"""Implausible readings per source: a four-state hidden Markov model with hard bounds.

The states are normal, spike, stuck and range (out of bounds).  What a reading shows is its
distance from the normal closes before and after it, its volume, and whether its close
or volume repeats that of a neighbouring reading.  Each state has a density for these, whose
parameters are fitted per source: the unit of distance is the source's median change, and the median and
spread of volumes and the usual shares of repeats are the source's own.  Forward-backward over each day of
a source gives the probabilities of the states; a reading is flagged if it is not normal with a
probability of at least ``decision``, or beyond hard bounds.

Rows are shuffled once, by (source, block).  A block is the whole source unless the source holds
more than ``block_rows`` rows; then it is cut at days, its parameters are worked out by distributed
aggregations, and as many neighbouring days come along on both sides as hold ``HALO`` usable closes, which is as far as any
reading is looked at from another.  So the blocks of a hot source give what the uncut source gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grouped_stream import floats, whole_groups
from tidemark.operators.medians import group_medians

STATES = ("normal", "spike", "stuck", "range")
DAY_US = 86_400_000_000
NO_TIME = -(2**62)

#: Chance to leave the normal state for each other one, and to stay in each other state.
ENTER = np.array([0.977, 0.01, 0.003, 0.01])
STAY = {1: 0.5, 2: 0.9, 3: 0.5}
#: Spikes: their distances, in median changes, and their volumes, in medians, are spread evenly over the logarithms of these ranges.
SPIKE_RANGE, VOLUME_RANGE = (3.0, 3e4), (4.0, 1e6)
#: Mean distance of a normal reading, in median changes of its source; and bounds of the fitted parameters, the mean
#: logarithm of volume (off its median) and the share of repeats.
SPREAD, VOLUME_SPREAD, REPEATS = 1.0, (0.1, 0.5), (0.2, 0.35)
#: Chance that a stuck source repeats its value.
STUCK = 0.98
#: Readings further away than this (in usable closes) are no neighbours; a close is judged by up to GROUP + 1 around it.
REACH, GROUP = 12, 3
HALO = REACH + GROUP + 2
#: Evidence is bounded, so that one reading does not outweigh all others.
MOST = np.exp(25.0)


@dataclass(frozen=True)
class Limits:
    """The limits of the statement, and the probability from which a reading is flagged.

    A missed reading is held to cost four times one that is flagged in vain.
    """

    spike_times: float = 10.0
    volume_times: float = 20.0
    run: int = 8
    decision: float = 0.2


def _transitions() -> np.ndarray:
    a = np.zeros((4, 4))
    a[0] = ENTER
    for s, stay in STAY.items():
        a[s, s] = stay
        a[s, 0] = (1 - stay) * 0.8
        for o in {1, 2, 3} - {s}:
            a[s, o] = (1 - stay) * 0.1
    return a


def forward_backward(like: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Posterior state probabilities of many sequences at once.

    like: (sequences, steps, states), emission likelihoods, 1 beyond a sequence's length.
    """
    a = _transitions()
    n, steps, k = like.shape
    alpha = np.empty_like(like)
    cur = like[:, 0] * ENTER
    cur /= cur.sum(1, keepdims=True)
    alpha[:, 0] = cur
    for t in range(1, steps):
        cur = (cur @ a) * like[:, t]
        cur /= cur.sum(1, keepdims=True)
        alpha[:, t] = cur
    beta = np.ones((n, k))
    for t in range(steps - 2, -1, -1):
        inside = (t + 1 < length)[:, None]
        nxt = (beta * like[:, t + 1]) @ a.T
        nxt /= nxt.sum(1, keepdims=True)
        beta = np.where(inside, nxt, 1.0)
        alpha[:, t] *= beta
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    return alpha


def _per_group_median(group: np.ndarray, value: np.ndarray, n_groups: int) -> np.ndarray:
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    start = np.searchsorted(g, np.arange(n_groups))
    count = np.searchsorted(g, np.arange(n_groups), side="right") - start
    out = np.full(n_groups, np.nan)
    some = count > 0
    lo, hi = start + (count - 1) // 2, start + count // 2
    out[some] = (v[lo[some]] + v[hi[some]]) / 2
    return out


def _run_lengths(seq: np.ndarray, tus: np.ndarray, value: np.ndarray, null: np.ndarray) -> np.ndarray:
    """For each row the number of consecutive readings (distinct times of its day, nulls skipped) with its value."""
    out = np.zeros(len(seq), dtype=np.int64)
    rows = np.flatnonzero(~null & (tus != NO_TIME))
    if not len(rows):
        return out
    s, t, v = seq[rows], tus[rows], value[rows]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    place = np.cumsum(fresh)  # one number per distinct time; a new day leaves a gap
    place = place + np.cumsum(np.r_[True, s[1:] != s[:-1]])
    good = ~np.isnan(v)
    rows, s, v, place = rows[good], s[good], v[good], place[good]
    if not len(rows):
        return out
    order = np.lexsort((place, v, s))
    s, v, p = s[order], v[order], place[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (p[1:] > p[:-1] + 1)]
    run = np.cumsum(new) - 1
    first, last = p[new], np.maximum.reduceat(p, np.flatnonzero(new))
    out[rows[order]] = (last - first + 1)[run]
    return out


def off_closes(close: np.ndarray, group: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Closes that, alone or with up to GROUP - 1 neighbours, depart to one side from both closes around them by more than their source's limit."""
    off = np.zeros(len(close), dtype=bool)
    for k in range(1, GROUP + 1):
        n = len(close) - k - 1
        if n <= 0:
            break
        before, after = close[:n], close[k + 1 :]
        same = group[:n] == group[k + 1 :]
        lim = limit[group[:n]]
        inside = np.stack([close[j : j + n] for j in range(1, k + 1)])
        hit = same & ((inside.min(0) - np.maximum(before, after) > lim) | (np.minimum(before, after) - inside.max(0) > lim))
        for j in range(1, k + 1):
            off[j : j + n] |= hit
    return off


def _per_group_mean(group: np.ndarray, value: np.ndarray, n_groups: int) -> np.ndarray:
    n = np.bincount(group, minlength=n_groups)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(group, value, minlength=n_groups) / n


def fitted(tbl: pa.Table, group: np.ndarray, n_groups: int, reps: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters of each source; those of a source cut into blocks come with its rows (columns __m to __s)."""
    rc, rv, rg = close[reps], volume[reps], group[reps]
    same = rg[1:] == rg[:-1]
    change = np.abs(np.diff(rc))[same]
    fv = np.isfinite(volume)
    own = {"m": _per_group_median(rg[1:][same], change, n_groups), "v": _per_group_median(group[fv], volume[fv], n_groups)}
    own["c"] = _per_group_mean(rg[1:][same], (change == 0).astype(float), n_groups)
    known = same & np.isfinite(rv[1:]) & np.isfinite(rv[:-1])
    own["w"] = _per_group_mean(rg[1:][known], (rv[1:] == rv[:-1])[known].astype(float), n_groups)
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.abs(np.log(volume / own["v"][group]))
    fs = np.isfinite(size)
    own["s"] = _per_group_mean(group[fs], size[fs], n_groups)
    first = np.searchsorted(group, np.arange(n_groups))
    cut = tbl.column("__cut").to_numpy(zero_copy_only=False).astype(bool)[first]
    return {k: np.where(cut, floats(tbl, f"__{k}")[0][first], x) for k, x in own.items()}


def emissions(distance: np.ndarray, size: np.ndarray, repeats: tuple, has: tuple, p: dict[str, np.ndarray], hard: np.ndarray) -> np.ndarray:
    """(rows, states) likelihood ratios to the normal state.

    distance in median changes and size as the logarithm of volume over its median, NaN where there is none;
    repeats and has tell of close and volume whether it equals a neighbour's, and whether there is one.
    A spike is one of price or of volume, and a stuck source is stuck in close or in volume: the likelier counts.
    A stuck close drifts away from the other prices, so distances in that state are normal ones or those of spikes.
    """
    def ratio(x: np.ndarray, spread: np.ndarray, limits: tuple[float, float], even: np.ndarray) -> np.ndarray:
        lo, hi = limits
        normal = np.exp(-np.minimum(np.abs(x) / spread, 600.0)) / spread
        out = np.where(x >= lo, even / np.log(hi / lo) / normal, 0.01)
        return np.where(np.isnan(x), 1.0, out)

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        price = ratio(distance, SPREAD, SPIKE_RANGE, 1 / np.clip(distance, *SPIKE_RANGE))
        spread = np.clip(p["s"], *VOLUME_SPREAD)
        amount = ratio(size, np.where(np.isnan(spread), VOLUME_SPREAD[1], spread), tuple(np.log(VOLUME_RANGE)), np.ones(len(size)))
        stuck = np.zeros(len(distance))
        for equal, there, share in zip(repeats, has, (p["c"], p["w"])):
            q = np.clip(np.nan_to_num(share), *REPEATS)
            stuck = np.maximum(stuck, np.where(~there, 1.0, np.where(equal, STUCK / q, (1 - STUCK) / (1 - q))))
        stuck = stuck * np.maximum(1.0, price / 2)
    like = np.stack([np.ones(len(distance)), np.maximum(price, amount), stuck, np.where(hard, MOST, 1 / MOST)], axis=1)
    return np.clip(like, 1 / MOST, MOST)


def judge(tbl: pa.Table, limits: Limits) -> pa.Table | None:
    """All readings of complete (source, block) groups, sorted by group, time, load and id."""
    if tbl.num_rows == 0:
        return None
    key = tbl.column("__block").to_numpy()
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    n_groups = int(group[-1]) + 1
    tus = tbl.column("__tus").to_numpy()
    day = np.where(tus == NO_TIME, NO_TIME, tus // DAY_US)
    (high, _), (low, _) = floats(tbl, "high"), floats(tbl, "low")
    (close, no_close), (volume, no_volume) = floats(tbl, "close"), floats(tbl, "volume")
    timed = tus != NO_TIME

    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        # one close per distinct time: the one of the last load
        usable = timed & np.isfinite(close) & (close > 0) & ~(close > high) & ~(close < low)
        reps = np.flatnonzero(usable)
        if len(reps):
            g, t = group[reps], tus[reps]
            reps = reps[np.r_[(g[1:] != g[:-1]) | (t[1:] != t[:-1]), True]]
        rc, rg = close[reps], group[reps]
        p = fitted(tbl, group, n_groups, reps, close, volume)
        limit = limits.spike_times * p["m"]
        normal = np.flatnonzero(~off_closes(rc, rg, limit))

        # the nearest normal close strictly before and after each row's time
        block_start = np.r_[True, (group[1:] != group[:-1]) | (tus[1:] != tus[:-1])]
        start_of = np.maximum.accumulate(np.where(block_start, np.arange(len(tus)), 0))
        ends = np.r_[np.flatnonzero(block_start)[1:], len(tus)]
        end_of = ends[np.cumsum(block_start) - 1]
        n_before, n_upto = np.searchsorted(reps, start_of), np.searchsorted(reps, end_of)  # reps before and up to the row's time
        before, after = np.full(len(tus), np.nan), np.full(len(tus), np.nan)
        if len(normal):
            i = np.searchsorted(normal, n_before) - 1
            at = normal[np.maximum(i, 0)]
            ok = timed & (i >= 0) & (rg[at] == group) & (n_before - at <= REACH)
            before[ok] = rc[at[ok]]
            i = np.searchsorted(normal, n_upto)
            at = normal[np.minimum(i, len(normal) - 1)]
            ok = timed & (i < len(normal)) & (rg[at] == group) & (at - n_upto < REACH)
            after[ok] = rc[at[ok]]

        # how far the reading departs to one side, and whether it is beyond the statement's limits
        lim, m = limit[group], p["m"][group]
        far, departs = np.full(len(tus), np.nan), np.zeros(len(tus), dtype=bool)
        for x in (high, low, close):
            over, under = x - np.fmax(before, after), np.fmin(before, after) - x
            d = np.where(np.isnan(before) | np.isnan(after), np.nan, np.maximum(np.maximum(over, under), 0.0))
            departs |= d > lim
            far = np.fmax(far, np.where(d == 0, 0.0, d / m))
        size = np.where(volume > 0, np.log(volume / p["v"][group]), np.nan)
        many = volume > limits.volume_times * p["v"][group]
        hard = (high < low) | (close < low) | (close > high) | (close <= 0) | (low <= 0)
        hard |= (np.isnan(close) & ~no_close) | (volume < 0) | (np.isnan(volume) & ~no_volume)

    of_row = {k: p[k][group] for k in ("c", "w", "s")}
    seq = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (day[1:] != day[:-1])]) - 1
    runs = [_run_lengths(seq, tus, close, no_close), _run_lengths(seq, tus, volume, no_volume)]
    spans = np.flatnonzero(block_start)
    repeats = tuple(np.maximum.reduceat(r, spans)[np.cumsum(block_start) - 1] > 1 for r in runs)  # of any row of that time
    like = emissions(far, size, repeats, (~no_close & timed, ~no_volume & timed), of_row, hard)
    post = posteriors(like, seq)
    state = np.where(hard, 3, post[:, 1:].argmax(1) + 1)
    flagged = hard | (1 - post[:, 0] >= limits.decision)
    exact = hard | departs | many | (np.maximum(*runs) >= limits.run)
    rows = np.flatnonzero(flagged & ~tbl.column("__halo").to_numpy(zero_copy_only=False).astype(bool))
    if not len(rows):
        return None
    return pa.table(
        {
            "bar_id": pc.take(tbl.column("bar_id"), pa.array(rows)),
            "state": pa.array(np.array(STATES, dtype=object)[state[rows]].tolist(), pa.string()),
            "p_spike": post[rows, 1],
            "p_stuck": post[rows, 2],
            "p_range": np.where(hard[rows], 1.0, post[rows, 3]),
            "verified": exact[rows],
        }
    )


def posteriors(like: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """State probabilities of all rows; seq numbers the sequences in order."""
    n_seq = int(seq[-1]) + 1
    seq_start = np.searchsorted(seq, np.arange(n_seq))
    length = np.diff(np.r_[seq_start, len(seq)])
    post = np.empty_like(like)
    by_length = np.argsort(length, kind="stable")
    lo = 0
    while lo < n_seq:  # sequences of like length together, about a million cells at a time
        hi = lo + 1
        while hi < n_seq and (hi - lo + 1) * length[by_length[hi]] <= 250_000:
            hi += 1
        some = by_length[lo:hi]
        steps = int(length[some].max())
        padded = np.ones((len(some), steps, 4))
        where = np.arange(steps)[None, :] < length[some][:, None]
        rows = (seq_start[some][:, None] + np.arange(steps)[None, :])[where]
        padded[where] = like[rows]
        post[rows] = forward_backward(padded, length[some])[where]
        lo = hi
    return post


FLAGGED = "bar_id long, state string, p_spike double, p_stuck double, p_range double, verified boolean"
PARAMETERS = ("m", "v", "c", "w", "s")


def flag_readings(bars: DataFrame, limits: Limits = Limits(), *, block_rows: int = 50_000) -> DataFrame:
    """Readings that are not normal (bar_id, state, probabilities, verified).

    ``verified`` tells that the exact limits hold too: high below low; close outside
    low..high; close or low at or below zero; close NaN; volume negative or NaN; high, low or close
    further than ``spike_times`` median changes, to one side, from the normal closes
    before and after (a close is not normal if it departs so, alone or with up to two neighbours, from the
    closes around); volume over ``volume_times`` the median volume; a run of ``run`` equal closes or volumes.

    Nulls are no reading and are skipped; rows of null time are judged by bounds and
    volume only; rows of null feed form a source of their own; repeated rows are
    judged each for itself; an empty table gives an empty result.  Of the input's
    columns only those named above are read, so extra columns do not matter.
    """
    tus = F.coalesce(F.unix_micros(F.col("time").cast("timestamp")), F.lit(NO_TIME))
    r = bars.select(
        F.col("bar_id").cast("long").alias("bar_id"),
        F.coalesce(F.concat(F.lit("f"), F.col("feed").cast("string")), F.lit("-")).alias("__feed"),
        tus.alias("__tus"),
        F.when(F.col("time").isNull(), F.lit(NO_TIME)).otherwise(F.floor(tus / DAY_US)).cast("long").alias("__day"),
        *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")],
        F.col("load_no").cast("long").alias("__load"),
    )
    hot = r.groupBy("__feed").count().where(F.col("count") > block_rows).select("__feed")
    plain = lambda d: d.select(
        "*", F.lit(0).cast("long").alias("__part"), F.lit(False).alias("__halo"), *[F.lit(None).cast("double").alias(f"__{k}") for k in PARAMETERS], F.lit(False).alias("__cut")
    )
    if hot.isEmpty():
        blocks = plain(r)
    else:
        blocks = plain(r.join(hot, "__feed", "left_anti")).unionByName(_cut_hot(r.join(hot, "__feed", "left_semi"), block_rows))
    blocks = blocks.withColumn("__block", F.xxhash64("__feed", "__part"))

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(batches, "__block", lambda t: judge(t, limits))

    return (
        blocks.select("__block", "__tus", "__load", "bar_id", "high", "low", "close", "volume", "__halo", *[f"__{k}" for k in PARAMETERS], "__cut")
        .repartition("__block")
        .sortWithinPartitions("__block", "__tus", "__load", "bar_id")
        .mapInArrow(run_partition, FLAGGED)
    )


def _usable() -> Column:
    ok = (F.col("__tus") != NO_TIME) & (F.col("close") > 0) & (F.col("close") < float("inf")) & ~F.isnan("close")
    ok &= F.coalesce(F.isnan("high") | (F.col("close") <= F.col("high")), F.lit(True))
    return F.coalesce(ok & F.coalesce(F.isnan("low") | (F.col("close") >= F.col("low")), F.lit(True)), F.lit(False))


def _days_of_blocks(r: DataFrame, block_rows: int) -> DataFrame:
    """(feed, day, part, halo): the days of each block, and those around it up to HALO usable closes away."""
    days = r.groupBy("__feed", "__day").agg(F.count("*").alias("__n"), F.count_distinct(F.when(_usable(), F.col("__tus"))).alias("__u"))
    by_day = Window.partitionBy("__feed").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(
        "__feed", "__day", F.floor((F.sum("__n").over(by_day) - F.col("__n")) / block_rows).alias("__own"),
        (F.sum("__u").over(by_day) - F.col("__u")).alias("__from"), F.sum("__u").over(by_day).alias("__to"),
    )
    spans = days.groupBy("__feed", "__own").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"))
    none = F.lit(None).cast("long")
    # blocks that begin less than HALO closes after the day's end: those before that place in the order of places
    ahead = days.select("__feed", "__day", (F.col("__to") + HALO).alias("__at"), F.lit(0).alias("__kind"), none.alias("__b"))
    ahead = ahead.unionByName(spans.select("__feed", none.alias("__day"), F.col("__from").alias("__at"), F.lit(1).alias("__kind"), F.col("__own").alias("__b")))
    w = Window.partitionBy("__feed").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    last = ahead.withColumn("__last", F.max("__b").over(w)).where("__kind = 0").select("__feed", "__day", "__last")
    # and blocks that end less than HALO closes before the day's beginning
    behind = days.select("__feed", "__day", (F.col("__from") - HALO).alias("__at"), F.lit(0).alias("__kind"), none.alias("__b"))
    behind = behind.unionByName(spans.select("__feed", none.alias("__day"), F.col("__to").alias("__at"), F.lit(1).alias("__kind"), F.col("__own").alias("__b")))
    w = Window.partitionBy("__feed").orderBy(F.desc("__at"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    first = behind.withColumn("__first", F.min("__b").over(w)).where("__kind = 0").select("__feed", "__day", "__first")
    d = days.select("__feed", "__day", "__own").join(last, ["__feed", "__day"]).join(first, ["__feed", "__day"])
    lo, hi = F.least(F.col("__own"), F.coalesce("__first", "__own")), F.greatest(F.col("__own"), F.coalesce("__last", "__own"))
    d = d.select("__feed", "__day", "__own", F.explode(F.sequence(lo, hi)).alias("__part"))
    return d.select("__feed", "__day", F.col("__part").cast("long").alias("__part"), (F.col("__part") != F.col("__own")).alias("__halo"))


def _parameters(r: DataFrame) -> DataFrame:
    """What ``fitted`` works out, for sources too large for one task; windows run per source and day."""
    by_day = Window.partitionBy("__feed").orderBy("__day")
    last = F.max_by(F.struct("close", "volume"), F.struct("__load", "bar_id"))
    rep = r.where(_usable()).groupBy("__feed", "__day", "__tus").agg(last.alias("x")).select("__feed", "__day", "__tus", "x")
    ends = rep.groupBy("__feed", "__day").agg(F.max_by("x", "__tus").alias("__last"))
    ends = ends.select("__feed", "__day", F.lag("__last").over(by_day).alias("__night"))
    step = Window.partitionBy("__feed", "__day").orderBy("__tus")
    both = rep.join(ends, ["__feed", "__day"]).select("__feed", "x", F.coalesce(F.lag("x").over(step), F.col("__night")).alias("y"))
    change = F.abs(F.col("x.close") - F.col("y.close"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    both = both.where("y is not null").select(
        "__feed", change.alias("__change"), F.when(finite("x.volume") & finite("y.volume"), (F.col("x.volume") == F.col("y.volume")).cast("double")).alias("__same")
    )
    shares = both.groupBy("__feed").agg(F.avg((F.col("__change") == 0).cast("double")).alias("__c"), F.avg("__same").alias("__w"))
    p = group_medians(both, "__feed", "__change", "__m").join(group_medians(r, "__feed", "volume", "__v"), "__feed", "full").join(shares, "__feed", "left")
    size = r.join(p.select("__feed", "__v"), "__feed").where((F.col("volume") > 0) & (F.col("volume") < float("inf")) & (F.col("__v") > 0))
    spread = size.groupBy("__feed").agg(F.avg(F.abs(F.ln(F.col("volume") / F.col("__v")))).alias("__s"))
    return p.join(spread, "__feed", "left")


def _cut_hot(r: DataFrame, block_rows: int) -> DataFrame:
    """Sources beyond block_rows: dealt, day by day, into blocks with halos and the parameters of the whole source."""
    d = r.join(_days_of_blocks(r, block_rows), ["__feed", "__day"]).join(_parameters(r), "__feed", "left")
    return d.withColumn("__cut", F.lit(True)).select(*r.columns, "__part", "__halo", *[f"__{k}" for k in PARAMETERS], "__cut")
