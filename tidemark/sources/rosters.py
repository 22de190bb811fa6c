"""Small driver-side inputs: symbol rosters and relative dates."""

from __future__ import annotations

import datetime as dt
import json
import random
import re


def draw_roster(pool: list[str], required: list[str], size: int, seed: int) -> list[str]:
    """``required`` and a seeded sample of the rest of the pool, ``size`` symbols in all, sorted."""
    rest = sorted(set(pool) - set(required))
    more = size - len(set(required))
    if more < 0 or more > len(rest):
        raise ValueError(f"cannot draw {size} symbols from {len(rest)} and {len(set(required))} required ones")
    return sorted({*required, *random.Random(seed).sample(rest, more)})


def save_roster(path: str, symbols: list[str], seed: int, source: str) -> None:
    with open(path, "w") as f:
        json.dump({"symbols": sorted(symbols), "seed": seed, "source": source}, f, indent=2)


def load_roster(path: str) -> list[str]:
    with open(path) as f:
        return json.load(f)["symbols"]


def parse_since(text: str, now: dt.datetime) -> dt.datetime:
    """A date, an ISO time, or ``Nd`` (N days before now); without a zone in UTC."""
    if m := re.fullmatch(r"(\d+)d", text.strip()):
        return now - dt.timedelta(days=int(m[1]))
    try:
        t = dt.datetime.fromisoformat(text.strip())
    except ValueError:
        raise ValueError(f"neither a date, a time nor a number of days: {text!r}") from None
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
