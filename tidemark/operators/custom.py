"""Declared parameters, and the plug-in base of custom strategies for the streamed fold, with one example."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from tidemark.operators.backtest import Bar, Entry, Exit, Position


@dataclass(frozen=True)
class Parameter:
    """A declared parameter with its allowed range or values."""

    default: Any
    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None

    def check(self, name: str, v: Any) -> Any:
        kind = type(self.default)
        right = isinstance(v, kind) or (kind is float and isinstance(v, int))
        if not right or (isinstance(v, bool) and kind is not bool):
            raise ValueError(f"{name}: {v!r} is no {kind.__name__}")
        if self.allowed is not None and v not in self.allowed:
            raise ValueError(f"{name}: {v!r} is not in {self.allowed}")
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            if (self.low is not None and v < self.low) or (self.high is not None and v > self.high):
                raise ValueError(f"{name}: {v!r} is outside [{self.low}, {self.high}]")
        return v


class Declared:
    """Rules with declared ``parameters`` (checked, in ``p``) and ``timeframes``."""

    parameters: dict[str, Parameter] = {}
    timeframes: tuple[str, ...] = ()

    def __init__(self, **given: Any):
        if not self.timeframes:  # not at class creation, as pickling by value makes classes bit by bit
            raise TypeError(f"{type(self).__name__} declares no timeframes")
        unknown = set(given) - set(self.parameters)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        self.p = {n: p.check(n, given.get(n, p.default)) for n, p in self.parameters.items()}


class Strategy(Declared):
    """Base of custom strategies; subclasses declare ``parameters`` and ``timeframes`` and answer ``on_bar``."""

    keep = 200

    def on_session_start(self, ts: dt.datetime) -> None: ...

    def on_trade_closed(self, trade: tuple) -> None: ...

    def on_bar(self, bar: Bar, position: Position | None, history: list[Bar]) -> list[Entry | Exit]:
        raise NotImplementedError


class BuyAndHold(Strategy):
    """Enter once, at the first possible bar, and hold."""

    timeframes = ("1m", "5m", "15m", "30m", "1h", "4h", "1d")

    def __init__(self, **given: Any):
        super().__init__(**given)
        self.done = False

    def on_bar(self, bar: Bar, position: Position | None, history: list[Bar]) -> list[Entry | Exit]:
        if self.done:
            return []
        self.done = True
        return [Entry("long", label="hold")]
