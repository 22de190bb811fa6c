"""The signal DSL: strategy documents parsed, checked, hashed and compiled to Column expressions."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.schema import BARS_PER_SESSION, TIMEFRAMES

SLOTS = ("entry_long", "entry_short", "exit_long", "exit_short")
#: The members of each node of the language.
NODES = {
    "and": {"op", "args"}, "or": {"op", "args"}, "not": {"op", "arg"}, "compare": {"op", "operator", "lhs", "rhs"},
    "indicator": {"op", "name"}, "price": {"op", "field"}, "time_of_day": {"op"}, "const": {"op", "value"}, "param": {"op", "name"},
}
BOOLEAN, OPERANDS = ("and", "or", "not", "compare"), ("indicator", "price", "time_of_day", "const", "param")
OPERATORS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
PRICES = ("open", "high", "low", "close")
SNAKE = re.compile(r"[a-z][a-z0-9_]*")


class SpecError(ValueError):
    """A strategy document that breaks the language's rules."""


@dataclass(frozen=True)
class Spec:
    """A checked strategy document."""

    doc: dict[str, Any]

    @property
    def name(self) -> str:
        return self.doc["name"]

    @property
    def timeframe(self) -> str:
        return self.doc["timeframes"][0]

    @property
    def indicators(self) -> list[ind.Indicator]:
        return [ind.Indicator(i["name"], i["type"], i.get("params") or {}) for i in self.doc.get("indicators", [])]

    @property
    def defaults(self) -> dict[str, Any]:
        return {p["name"]: p["default"] for p in self.doc.get("parameters", [])}

    @property
    def size(self) -> int:
        return int((self.doc.get("position_sizing") or {}).get("size", 1))


def parse(text: str | dict[str, Any]) -> Spec:
    """A document from JSON; clauses stored as text are parsed too; raises SpecError."""
    try:
        doc = json.loads(text) if isinstance(text, str) else dict(text)
    except ValueError as e:
        raise SpecError(f"no JSON: {e}") from None
    if not isinstance(doc, dict):
        raise SpecError("a document is an object")
    for slot in SLOTS:
        doc[slot] = _recovered(doc.get(slot))
    _check(doc)
    return Spec(doc)


def _recovered(x: Any) -> Any:
    if isinstance(x, str):
        try:
            return _recovered(json.loads(x))
        except ValueError:
            raise SpecError("a clause is neither an object nor the JSON of one") from None
    if isinstance(x, dict):
        return {k: _recovered(v) if k in ("args", "arg", "lhs", "rhs") else v for k, v in x.items()}
    if isinstance(x, list):
        return [_recovered(v) for v in x]
    return x


def _check(doc: dict[str, Any]) -> None:
    if not SNAKE.fullmatch(str(doc.get("name", ""))):
        raise SpecError("the name must be in snake case")
    frames = doc.get("timeframes")
    if not isinstance(frames, list) or len(frames) != 1 or frames[0] not in TIMEFRAMES:
        raise SpecError("exactly one known timeframe is needed")
    declared = {"indicator": [i.get("name") for i in doc.get("indicators") or []], "param": [p.get("name") for p in doc.get("parameters") or []]}
    for kind, names in declared.items():
        if len(set(names)) < len(names) or not all(SNAKE.fullmatch(str(n)) for n in names):
            raise SpecError(f"{kind} names must be unique and in snake case")
    if len(declared["indicator"]) > 4 or len(declared["param"]) > 5:
        raise SpecError("at most 4 indicators and 5 parameters")
    for i in doc.get("indicators") or []:
        try:
            ind.check_arguments(i.get("type"), i.get("params") or {})
        except ValueError as e:
            raise SpecError(str(e)) from None
        if i["type"] in ind.DAILY_ONLY and frames[0] in ("5m", "15m", "1h"):
            raise SpecError(f"{i['type']} is for daily bars")
    if doc["entry_long"] is None and doc["entry_short"] is None:
        raise SpecError("an entry is needed")
    for slot in SLOTS:
        for node in walk(doc[slot]):
            op = node.get("op")
            if op not in NODES or set(node) != NODES[op]:
                raise SpecError(f"{slot}: unknown node {op!r} or members {sorted(node)}")
            if op == "compare" and node["operator"] not in OPERATORS:
                raise SpecError(f"{slot}: unknown operator {node['operator']!r}")
            if op in ("and", "or") and not (isinstance(node["args"], list) and node["args"]):
                raise SpecError(f"{slot}: {op} needs arguments")
            if op == "price" and node["field"] not in PRICES:
                raise SpecError(f"{slot}: unknown price {node['field']!r}")
            if op in declared and node["name"] not in declared[op]:
                raise SpecError(f"{slot}: {op} {node['name']!r} is not declared")


def walk(node: Any) -> Iterator[dict[str, Any]]:
    """A clause and all nodes below it."""
    if node is None:
        return
    if not isinstance(node, dict):
        raise SpecError("a node is an object")
    yield node
    for k in ("arg", "lhs", "rhs"):
        if k in node:
            yield from walk(node[k])
    for a in node.get("args") or []:
        yield from walk(a)


def to_column(node: dict[str, Any], params: dict[str, Column]) -> Column:
    """The expression of a clause over bars with indicator columns.

    A comparison with null or NaN is false, except that != with NaN is true.
    """
    op = node["op"]
    if op == "compare":
        a, b = operand(node["lhs"], params), operand(node["rhs"], params)
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        got = OPERATORS[node["operator"]](a, b)
        return F.coalesce(nan | got if node["operator"] == "!=" else ~nan & got, F.lit(False))
    if op == "not":
        return ~to_column(node["arg"], params)
    parts = [to_column(a, params) for a in node["args"]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if op == "and" else (out | p)
    return out


def operand(node: dict[str, Any], params: dict[str, Column]) -> Column:
    op = node["op"]
    if op == "indicator":
        return F.col(node["name"])
    if op == "price":
        return F.col(node["field"])
    if op == "time_of_day":
        return F.hour("ts") * 60 + F.minute("ts")
    return F.lit(float(node["value"])) if op == "const" else params[node["name"]]


def signals(spec: Spec, params: dict[str, Column] | None = None) -> dict[str, Column]:
    """The four flags (el, es, xl, xs), false where an indicator is missing; params default to the document's."""
    given = {k: F.lit(v) for k, v in spec.defaults.items()} | (params or {})
    short = dict(zip(SLOTS, ("el", "es", "xl", "xs")))
    return {s: (F.col("warm") & to_column(spec.doc[k], given)) if spec.doc[k] is not None else F.lit(False) for k, s in short.items()}


def clauses(entry: dict[str, Any]) -> list[dict[str, Any]]:
    """The arguments of a top-level and; else the clause itself."""
    return entry["args"] if entry["op"] == "and" else [entry]


def render(node: dict[str, Any]) -> str:
    """A clause as readable text."""
    op = node["op"]
    if op == "compare":
        return f"{render(node['lhs'])} {node['operator']} {render(node['rhs'])}"
    if op in ("and", "or"):
        return "(" + f" {op.upper()} ".join(map(render, node["args"])) + ")"
    return {
        "not": lambda: f"NOT {render(node['arg'])}", "indicator": lambda: node["name"], "param": lambda: f"param.{node['name']}",
        "price": lambda: f"price.{node['field']}", "time_of_day": lambda: "time_of_day", "const": lambda: repr(float(node["value"])),
    }[op]()


#: The members of a document and of its parts, each with the value that stands for an absent one
#: (REQUIRED: it must be there; None: null).  Members under FREE are text for readers and no logic.
REQUIRED = object()
MEMBERS = {
    "document": {
        "name": REQUIRED, "archetype": REQUIRED, "thesis": None, "supported_assets": [], "timeframes": [], "parameters": [], "indicators": [],
        "entry_long": None, "entry_short": None, "exit_long": None, "exit_short": None, "position_sizing": {"rule": "fixed", "size": 1},
    },
    "parameter": {"name": REQUIRED, "type": REQUIRED, "default": REQUIRED, "range_min": None, "range_max": None, "description": None},
    "indicator": {"name": REQUIRED, "type": REQUIRED, "params": {}},
    "position_sizing": {"rule": "fixed", "size": 1},
}
FREE = {"document": {"name", "thesis"}, "parameter": {"description"}, "indicator": set(), "position_sizing": set()}
#: Fixed value: what precedes the source text of a hand-written strategy in its hash.
SOURCE_DOMAIN = b"manual-strategy:v1\n"


def _filled(kind: str, x: dict[str, Any]) -> dict[str, Any]:
    """The logic of a document or part: every member there, nulls as if absent; raises SpecError for others or missing ones."""
    strange = sorted(set(x) - set(MEMBERS[kind]))
    if strange:
        raise SpecError(f"{kind}: unknown members {strange}")
    full = {k: default if x.get(k) is None else x[k] for k, default in MEMBERS[kind].items()}
    lacking = [k for k, v in full.items() if v is REQUIRED]
    if lacking:
        raise SpecError(f"{kind}: {lacking} missing")
    return {k: v for k, v in full.items() if k not in FREE[kind]}


def _unordered(node: Any) -> Any:
    """A clause whose and/or arguments stand in the order of their JSON."""
    if not isinstance(node, dict):
        return node
    out = {k: [_unordered(a) for a in v] if k == "args" else _unordered(v) for k, v in node.items()}
    if "args" in out:
        out["args"].sort(key=lambda a: json.dumps(a, sort_keys=True))
    return out


def spec_hash(spec: Spec) -> str:
    """sha256 of the logic: without name, thesis and descriptions; order of lists and and/or arguments does not count.

    An absent member, a null one and one with its default are the same; a member that the language does not know
    is an error, so that no logic is left out in silence.  Names of indicators and parameters count.
    """
    doc = _filled("document", spec.doc)
    by_name = lambda kind, rows: sorted((_filled(kind, r) for r in rows), key=lambda r: r["name"])
    doc |= {"parameters": by_name("parameter", doc["parameters"]), "indicators": by_name("indicator", doc["indicators"])}
    doc |= {k: sorted(doc[k]) for k in ("supported_assets", "timeframes")} | {k: _unordered(doc[k]) for k in SLOTS}
    doc["position_sizing"] = _filled("position_sizing", doc["position_sizing"])
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def source_hash(strategy: type) -> str:
    """sha256 of a hand-written strategy's source text; raises TypeError where there is none."""
    try:
        text = inspect.getsource(strategy)
    except OSError as e:
        raise TypeError(f"{strategy.__name__} has no source") from e
    return hashlib.sha256(SOURCE_DOMAIN + text.encode()).hexdigest()


def signal_frequency(ready: DataFrame, spec: Spec, slot: str) -> DataFrame:
    """Per symbol: bars, warm bars and their share, hits of the entry and of each of its clauses, one row per clause."""
    given = {k: F.lit(v) for k, v in spec.defaults.items()}
    parts = clauses(spec.doc[slot])
    full = to_column(spec.doc[slot], given)
    hits = [F.count_if(F.col("warm") & to_column(c, given)).alias(f"c{i}") for i, c in enumerate(parts)]
    a = ready.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.count_if("warm").alias("warm_bars"), F.count_if(F.col("warm") & full).alias("full_hits"), *hits)
    rows = F.array(*[F.struct(F.lit(render(c)).alias("clause"), F.col(f"c{i}").alias("clause_hits")) for i, c in enumerate(parts)])
    least = F.least(*[F.col(f"c{i}") for i in range(len(parts))]) if len(parts) > 1 else F.col("c0")
    return a.select("symbol", "n_bars", "warm_bars", (F.col("warm_bars") / F.col("n_bars")).alias("warm_ratio"), "full_hits", F.round(F.col("full_hits") / F.nullif(least, F.lit(0)), 6).alias("full_to_least"), F.explode(rows).alias("r")).select("*", "r.*").drop("r")


@dataclass(frozen=True)
class Finding:
    """Something a check of a document found."""

    kind: str
    slot: str
    text: str


def lint(spec: Spec) -> list[Finding]:
    """Clauses that cannot hold, and indicators that never warm up in a session or a strategy's buffer."""
    found = []
    types = {i.name: i.type for i in spec.indicators}
    numbers = {k: float(v) for k, v in spec.defaults.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    for slot in SLOTS:
        for node in _outside_not(spec.doc[slot]):
            sides = (node["lhs"], node["rhs"], node["operator"])
            if node["rhs"]["op"] == "indicator":
                sides = (node["rhs"], node["lhs"], MIRRORED[node["operator"]])
            a, b, operator = sides
            if a["op"] != "indicator" or b["op"] != "param" or types[a["name"]] not in ind.RANGES or b["name"] not in numbers:
                continue
            low, high = ind.RANGES[types[a["name"]]]
            v = numbers[b["name"]]
            never = {"<": low >= v, "<=": low > v, ">": high <= v, ">=": high < v, "==": not low <= v <= high, "!=": False}[operator]
            if never:
                found.append(Finding("unreachable", slot, f"{types[a['name']]}({a['name']}) {operator} {v} never holds in [{low}, {high}]"))
    total = sum(ind.lookback(i.type, i.params) for i in spec.indicators)
    room = BARS_PER_SESSION.get(spec.timeframe)
    if room is not None and any(ind.lookback(i.type, i.params) > room for i in spec.indicators):
        found.append(Finding("warmup", "", f"lookback {total} exceeds the {room} bars of a session"))
    for i in spec.indicators:
        if room is not None and ind.need(i.type, i.params) > room >= ind.lookback(i.type, i.params):
            found.append(Finding("never_warm", "", f"{i.name} needs {ind.need(i.type, i.params)} bars, a session has {room}"))
        if ind.need(i.type, i.params) > ind.buffer_length(spec.indicators):
            found.append(Finding("short_buffer", "", f"{i.name} needs more bars than a strategy keeps"))
    return found


def _outside_not(node: Any) -> Iterator[dict[str, Any]]:
    if node is None or node["op"] == "not":
        return
    if node["op"] == "compare":
        yield node
    for a in node.get("args") or []:
        yield from _outside_not(a)


def gate(spec: Spec, allowed: dict[str, tuple[set[str], set[str]]] | None = None) -> None:
    """Raise SpecError for a document that can never trade, or that a table of archetypes does not allow.

    An entry that cannot hold, and an indicator whose lookback exceeds the bars of a session, are fatal; the other
    findings of ``lint`` are not.  ``allowed`` gives the assets and timeframes of each archetype, if there is such a table.
    """
    fatal = [f.text for f in lint(spec) if f.kind == "warmup" or (f.kind == "unreachable" and f.slot.startswith("entry"))]
    if allowed is not None:
        assets, frames = allowed.get(spec.doc.get("archetype"), (set(), set()))
        fatal += [f"{spec.doc.get('archetype')} is not for {x}" for x in spec.doc.get("supported_assets") or [] if x not in assets]
        fatal += [f"{spec.doc.get('archetype')} is not for {x}" for x in spec.doc["timeframes"] if x not in frames]
    if fatal:
        raise SpecError("; ".join(fatal))
