"""SQL that brings mixed stamps to UTC, written apart from ``operators.instants``: by strptime and the engine's own time zones."""

from __future__ import annotations

_TAIL = r"(?: ?(Z|[+-]\d\d:?\d\d))?(?: ([A-Z]{2,5}))?(?: ?\[([A-Za-z0-9_/+-]+)\]| ([A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+))?$"
_CLOCKS = ["%H:%M:%S.%f", "%H:%M:%S", "%H:%M", "%I:%M:%S.%f %p", "%I:%M:%S %p", "%I:%M %p"]
_DAYS = ["%Y-%m-%d ", "%d.%m.%Y ", "%m/%d/%Y ", "%d %b %Y "]
_FORMATS = ", ".join(f"'{d}{c}'" for d in _DAYS for c in _CLOCKS)
#: Shapes of a head, after white space, fractions and short years are made alike.
_SHAPES = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}) \d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?: [AaPp][Mm])?"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}')"


def _head(x: str) -> str:
    """One form of date and time: blanks between, a dot before at most six digits, four digits of a year."""
    x = _sub(x, r"^[A-Z][a-z]{2}, (\d)", r"\1")
    x = _sub(x, r"^(\d{4})(\d{2})(\d{2})[_T](\d{2})(\d{2})(\d{2})", r"\1-\2-\3 \4:\5:\6")
    x = _sub(x, r"^(\d{4}-\d{2}-\d{2})T", r"\1 ")
    x = _sub(x, r"(:\d{2})[.,](\d{1,6})\d{0,3}( [AaPp][Mm])?$", r"\1.\2\3")
    x = _sub(x, r"^(\d{1,2}/\d{1,2})/(\d{2}) ", r"\1/20\2 ")
    return _sub(x, r"(\d)([AaPp][Mm])$", r"\1 \2")


def stamps(name: str, source: str, text: str, zone: str) -> str:
    """CTEs: ``name`` is ``source`` (a table or CTE) with the column ``instant`` of its stamps, as ``operators.instants`` has it."""
    n = name
    return f"""
{n}_a AS (SELECT *, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') AS s_ FROM {source}),
{n}_b AS (SELECT *, regexp_full_match(s_, '\\d{{1,16}}(\\.\\d+)?|\\d(\\.\\d+)?[eE]\\+?\\d{{1,2}}') AS bare_,
  regexp_extract(s_, '{_TAIL}', ['off', 'abbr', 'z1', 'z2']) AS t_ FROM {n}_a),
{n}_c AS (SELECT *, CASE WHEN bare_ THEN try_cast(s_ AS DECIMAL(38, 12)) END AS num_,
  upper(t_.abbr) IN ('AM', 'PM') AS clock_ FROM {n}_b),
{n}_d AS (SELECT *, CASE WHEN num_ < 1e11 THEN CAST(floor(num_ * 1000000) AS BIGINT) WHEN num_ < 1e14 THEN CAST(floor(num_ * 1000) AS BIGINT) WHEN num_ < 1e17 THEN CAST(floor(num_) AS BIGINT) END AS epoch_,
  {_head(f"CASE WHEN clock_ THEN s_ ELSE regexp_replace(s_, '{_TAIL}', '') END")} AS h_,
  CASE WHEN clock_ THEN '' ELSE t_.off END AS off_, CASE WHEN clock_ THEN '' ELSE t_.abbr END AS abbr_,
  coalesce(nullif(t_.z1, ''), nullif(t_.z2, ''), nullif(trim({zone}), '')) AS zone_ FROM {n}_c),
{n}_e AS (SELECT d.*, z.name AS known_, CASE WHEN regexp_full_match(h_, '{_SHAPES}') THEN try_strptime(h_, [{_FORMATS}]) END AS w_,
  CASE WHEN off_ = 'Z' THEN 0 WHEN off_ <> '' THEN (CASE WHEN off_[1] = '-' THEN -1 ELSE 1 END) * (CAST(off_[2:3] AS INT) * 60 + CAST(off_[-2:] AS INT))
    WHEN abbr_ <> '' THEN map {{'UTC': 0, 'GMT': 0, 'EST': -300, 'EDT': -240, 'CET': 60, 'CEST': 120, 'JST': 540}}[abbr_] END AS min_
  FROM {n}_d d LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) z ON z.name = zone_),
{n}_f AS (SELECT *, CASE WHEN min_ IS NULL AND w_ IS NOT NULL THEN list_distinct(list_filter(list_transform(
    [w_ - INTERVAL 26 HOUR, w_ + INTERVAL 26 HOUR], lambda x: epoch_us(w_) - (epoch_us(x) - epoch_us(x AT TIME ZONE known_))),
    lambda u: epoch_us(make_timestamptz(u) AT TIME ZONE known_) = epoch_us(w_))) END AS u_ FROM {n}_e),
{n} AS (SELECT *, CASE WHEN {text} IS NULL THEN NULL WHEN epoch_ IS NOT NULL THEN strftime(make_timestamp(epoch_), '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN w_ IS NULL OR (off_ <> '' AND off_ <> 'Z' AND (abs(min_) > 1080 OR CAST(off_[-2:] AS INT) > 59)) OR (abbr_ <> '' AND off_ = '' AND min_ IS NULL) THEN 'unreadable'
    WHEN min_ IS NOT NULL THEN strftime(w_ - to_minutes(min_), '%Y-%m-%dT%H:%M:%S.%fZ') WHEN zone_ IS NULL THEN 'nozone' WHEN known_ IS NULL THEN 'unreadable'
    WHEN len(u_) = 2 THEN 'ambiguous' WHEN len(u_) = 0 THEN 'nonexistent' ELSE strftime(make_timestamp(u_[1]), '%Y-%m-%dT%H:%M:%S.%fZ') END AS instant FROM {n}_f)"""
