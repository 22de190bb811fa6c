"""Mixed timestamp formats and time zones to one UTC form.

An ordered cascade of anchored date patterns splits a text into year, month, day and
rest; one strict pattern reads time and zone from the rest.  An offset or zone in the
text outranks the row's zone.  Wall times are resolved against the zone's offsets a
day before and after: two instants are ambiguous, none is nonexistent.  Everything
runs as built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CET": 60, "CEST": 120, "JST": 540}
#: Month names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

DAY = 86_400_000_000
TARGET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"
#: The cascade: name, anchored pattern, groups of year, month, day; the last group is the rest.
DATES = (
    ("iso", r"^(\d{4})-(\d{2})-(\d{2})[T ](.*)$", (1, 2, 3)),
    ("dots", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) (.*)$", (3, 2, 1)),
    ("slashes", r"^(\d{1,2})/(\d{1,2})/(\d{4}) (.*)$", (3, 1, 2)),
    ("short_slashes", r"^(\d{1,2})/(\d{1,2})/(\d{2}) (.*)$", (3, 1, 2)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[_T](\d{6}.*)$", (1, 2, 3)),
    ("named", r"^(?:[A-Z][a-z]{2}, )?(\d{1,2}) (" + "|".join(MONTHS) + r") (\d{4}) (.*)$", (3, 2, 1)),
)
TIME = r"^(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp][Mm]))?"
ZONE = r"(?: ?(Z|[+-]\d{2}:?\d{2}))?(?: ([A-Z]{2,5}))?(?: ?\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\]| ([A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+))?$"
REST = TIME + ZONE
#: Groups of REST.
GROUPS = ("h", "mi", "s", "f", "ap", "off", "abbr", "z1", "z2")
EPOCH = r"^\d{1,16}(?:\.\d+)?$|^\d(?:\.\d+)?[eE]\+?\d{1,2}$"


def _zone_micros(micros: Column, zone: Column) -> Column:
    """Wall time, in microseconds, of an instant in a zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def _stage(d: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """d with only the columns ``keep`` and new ones, each computed once.

    The new ones are generated as one row, as the optimiser neither merges projections nor pushes
    predicates across a generator: whatever is asked of the result, the expressions below stay as long as they are written.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return d.select(*keep, made.alias("__x")).select(*keep, *[F.col(f"__x.{n}").alias(n) for n in columns])


def _date_parts() -> Column:
    """(format, date, rest) by the first pattern of the cascade that matches __s."""
    part = None
    for name, pattern, (y, mo, dy) in DATES:
        g = lambda i, p=pattern: F.regexp_extract("__s", p, i)
        year = F.concat(F.lit("20"), g(y)) if name == "short_slashes" else g(y)
        month = g(mo)
        if name == "named":
            month = F.element_at(F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))]), g(mo))
        got = F.struct(F.lit(name).alias("format"), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(g(dy), 2, "0")).alias("date"), g(4).alias("rest"))
        cond = F.col("__s").rlike(pattern)
        part = F.when(cond, got) if part is None else part.when(cond, got)
    return part


def _wall() -> Column:
    """Microseconds of the wall time read from __date and __g; null where it is none."""
    g = lambda n: F.col(f"__g.{n}")
    num_of = lambda n: F.expr(f"coalesce(try_cast(__g.{n} as int), 0)")
    h12 = F.when(num_of("h").between(1, 12), num_of("h") % 12 + F.when(F.upper(g("ap")) == "PM", 12).otherwise(0))
    hour = F.when(g("ap") == "", num_of("h")).otherwise(h12)
    fine = (hour < 24) & (num_of("mi") < 60) & (num_of("s") < 60)
    micros = (
        F.unix_date("__date").cast("long") * DAY
        + (hour * 3600 + num_of("mi") * 60 + num_of("s")).cast("long") * 1_000_000
        + F.rpad(F.substring(g("f"), 1, 6), 6, "0").cast("long")
    )
    return F.when(fine & F.col("__date").isNotNull() & (g("h") != ""), micros)


def _zone_parts(zone: str) -> dict[str, Column]:
    """Offset in minutes, zone name, and whether the text's offset or abbreviation is none."""
    g = lambda n: F.col(f"__g.{n}")
    sign = F.when(F.substring(g("off"), 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(g("off"), "[^0-9]", "")
    two = lambda i: F.coalesce(F.substring(digits, i, 2).try_cast("int"), F.lit(0))
    given = F.when(g("off") == "Z", F.lit(0)).when(g("off") != "", sign * (two(1) * 60 + two(3)))
    abbr = F.element_at(F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))]), g("abbr"))
    offset = F.coalesce(given, F.when(g("abbr") != "", abbr))
    in_text = F.coalesce(F.nullif(g("z1"), F.lit("")), F.nullif(g("z2"), F.lit("")))
    bad = (F.abs(given) > 18 * 60) | (two(3) > 59)
    return {
        "__off": offset, "__zone": F.coalesce(in_text, F.nullif(F.trim(F.col(zone)), F.lit(""))),
        "__wrong": F.coalesce(bad, F.lit(False)) | (offset.isNull() & (g("abbr") != "")),
    }


def instants(df: DataFrame, text: str, zone: str) -> DataFrame:
    """Add ``instant`` (YYYY-MM-DDTHH:MM:SS.ffffffZ, or why there is none) and ``format`` (the pattern that read it).

    Reasons: ambiguous and nonexistent (wall time met twice or never in its zone), nozone,
    unreadable (also empty texts, impossible dates and unknown zone names).  Digits finer
    than a microsecond are cut off.  A null text gives nulls.  Bare numbers are
    Unix seconds, milliseconds or microseconds by their size.  Columns of df named instant
    or format are replaced; names that begin with two underscores are the operator's own.
    """
    kept = [c for c in df.columns if c not in ("instant", "format")]
    d = _stage(df, df.columns, {"__s": F.regexp_replace(F.col(text), r"^\s+|\s+$", "")})
    num = F.when(F.col("__s").rlike(EPOCH), F.expr("try_cast(__s as decimal(38,12))"))
    d = _stage(d, df.columns, {"__num": num, "__p": F.when(num.isNull(), _date_parts())})
    scale = F.when(F.col("__num") < F.lit(10**11), F.lit(1_000_000)).when(F.col("__num") < F.lit(10**14), F.lit(1_000)).when(F.col("__num") < F.lit(10**17), F.lit(1))
    rest = F.when(F.col("__p.rest").rlike(REST), F.col("__p.rest"))
    d = _stage(
        d, df.columns,
        {
            "__epoch": F.floor(F.col("__num") * scale).cast("long"), "__format": F.col("__p.format"), "__date": F.expr("try_cast(__p.date as date)"),
            "__g": F.struct(*[F.regexp_extract(rest, REST, i + 1).alias(n) for i, n in enumerate(GROUPS)]),
        },
    )
    d = _stage(d, [*df.columns, "__epoch", "__format"], {"__wall": _wall(), **_zone_parts(zone)})
    # a zone is known if a time in it can be read
    known = F.col("__zone").isNotNull() & F.concat(F.lit("2000-01-01 00:00:00 "), "__zone").try_cast("timestamp").isNotNull()
    stems = [*df.columns, "__epoch", "__format", "__wall", "__off", "__zone", "__wrong"]
    d = _stage(d, stems, {"__ok": known, "__z": F.when(F.col("__off").isNull() & known, F.col("__zone"))})
    wall = F.col("__wall")
    d = _stage(d, [*stems, "__ok", "__z"], {f"__g{k}": wall - (_zone_micros(wall + shift, F.col("__z")) - (wall + shift)) for k, shift in ((1, -DAY), (2, DAY))})
    d = _stage(d, [*stems, "__ok"], {f"__c{k}": F.when(_zone_micros(F.col(f"__g{k}"), F.col("__z")) == wall, F.col(f"__g{k}")) for k in (1, 2)})
    by_offset = F.when(F.col("__off").isNotNull(), wall - F.col("__off").cast("long") * 60_000_000)
    d = _stage(d, [*stems, "__ok", "__c1", "__c2"], {"__u": F.coalesce(F.col("__epoch"), by_offset, F.coalesce("__c1", "__c2"))})
    both = F.col("__c1").isNotNull() & F.col("__c2").isNotNull() & (F.col("__c1") != F.col("__c2"))
    readable = F.col("__epoch").isNotNull() | (wall.isNotNull() & ~F.col("__wrong"))
    needs_zone = F.col("__epoch").isNull() & F.col("__off").isNull()
    out = (
        F.when(F.col(text).isNull(), F.lit(None))
        .when(~readable | (needs_zone & F.col("__zone").isNotNull() & ~F.col("__ok")), "unreadable")
        .when(needs_zone & F.col("__zone").isNull(), "nozone")
        .when(needs_zone & both, "ambiguous")
        .when(needs_zone & F.col("__c1").isNull() & F.col("__c2").isNull(), "nonexistent")
        .otherwise(_stamp())
    )
    fmt = F.when(F.col("__epoch").isNotNull(), F.lit("epoch")).otherwise(F.col("__format"))
    return _stage(d, kept, {"instant": out, "format": fmt})


def _stamp() -> Column:
    """The target form of the instant __u."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(floor(__u / 86400000000D) as int)")).cast("string")
    left = F.expr("pmod(__u, 86400000000L)")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(
        date, F.lit("T"), two(F.floor(left / 3_600_000_000)), F.lit(":"), two(F.floor(left / 60_000_000) % 60), F.lit(":"),
        two(F.floor(left / 1_000_000) % 60), F.lit("."), F.lpad((left % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def all_stamps(raw_bars: DataFrame, generations: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The stamps of the three tables (src, row_id, stamp, instant, format)."""
    take = lambda d, src, i, t, z: d.select(F.lit(src).alias("src"), F.col(i).cast("long").alias("row_id"), F.col(t).alias("stamp"), F.col(z).alias("zone"))
    s = (
        take(raw_bars, "raw_bars_5m", "raw_id", "time", "zone")
        .unionByName(take(generations, "generations", "id", "generated_at", "recorded_zone"))
        .unionByName(take(evaluations, "evaluations", "id", "evaluated_at", "recorded_zone"))
    )
    return instants(s, "stamp", "zone")


def to_normalise(stamps: DataFrame) -> DataFrame:
    """Those that are not yet written in the target form (src, row_id, instant)."""
    return stamps.where(F.col("stamp").isNotNull() & ~F.col("stamp").rlike(TARGET)).select("src", "row_id", "instant")
