"""Schemas that drift between files: a catalogue of column lifespans and one consistent table.

Every file's members and their JSON types are exploded into a catalogue of one
row per (producer, file, path).  Lags over the files of a producer and path give
islands of presence; their starts and ends, and changes of type, are the log.
A table of aliases gives the casts that read all files into one schema; members
that no alias names are carried in the column ``rest``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depth of paths per kind: members of the top, of objects in it, of objects in arrays in it.
NESTED, ELEMENTS, MEMBERS = "members of objects", "elements of an array", "members of objects in arrays"


def json_type(v: Column) -> Column:
    """object, array, string, number or boolean of a variant; null for a JSON null."""
    t = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return (
        F.when(t == "OBJECT", "object").when(t == "ARRAY", "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t != "VOID", "number")
    )


def _exploded(df: DataFrame, v: str, key: str, value: str, kind: str, keep: list[str]) -> DataFrame:
    """Members (kind object) or elements (kind array) of the variant column v; other values give no rows."""
    wanted = f"if(schema_of_variant({v}) like '{kind}%', {v}, null)"
    return _lateral(df, f"{', '.join(keep)}, e.key as {key}, e.value as {value}", wanted)


def _lateral(df: DataFrame, columns: str, exploded: str) -> DataFrame:
    """Select from df and, as e, the exploded variant; the table function is there in SQL only."""
    view = f"tidemark_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(f"select {columns} from {view}, lateral variant_explode({exploded}) as e")
    finally:
        df.sparkSession.catalog.dropTempView(view)


def file_paths(df: DataFrame, column: str, kind: str) -> DataFrame:
    """(stream, file_no, json_path, types) for each file; the types are a sorted array without null."""
    base = df.select("stream", "file_no", F.try_parse_json(F.col(column)).alias("v")).where("v is not null and file_no is not null")
    ids = ["stream", "file_no"]
    if kind == ELEMENTS:
        top = _exploded(base, "v", "k", "x", "ARRAY", ids)
        inner = _exploded(top, "x", "k2", "y", "OBJECT", ids)
        found = top.select(*ids, F.lit("[]").alias("json_path"), json_type(F.col("x")).alias("t")).unionByName(
            inner.select(*ids, F.concat(F.lit("[]."), "k2").alias("json_path"), json_type(F.col("y")).alias("t"))
        )
    else:
        top = _exploded(base, "v", "k", "x", "OBJECT", ids)
        found = top.select(*ids, F.col("k").alias("json_path"), json_type(F.col("x")).alias("t"))
        if kind == NESTED:
            inner = _exploded(top, "x", "k2", "y", "OBJECT", [*ids, "k"])
            sep = "."
        else:
            elements = _exploded(top, "x", "k1", "e", "ARRAY", [*ids, "k"])
            inner = _exploded(elements, "e", "k2", "y", "OBJECT", [*ids, "k"])
            sep = "[]."
        found = found.unionByName(inner.select(*ids, F.concat("k", F.lit(sep), "k2").alias("json_path"), json_type(F.col("y")).alias("t")))
    return found.groupBy(*ids, "json_path").agg(F.sort_array(F.collect_set("t")).alias("types"))


def field_changes(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Changes from file to file of each stream (field, stream, file_no, json_path, change).

    Only rows with valid JSON count; a file without any is passed over.  A stream's
    first file starts its columns without a change.  A JSON null is a member without type.
    Null streams form a stream of their own; rows of null file_no are left out; an
    object with a repeated key is not valid.  Empty tables give an empty result.
    """
    valid = df.where(F.try_parse_json(F.col(column)).isNotNull() & F.col("file_no").isNotNull())
    files = valid.select("stream", "file_no").distinct()
    by_file = Window.partitionBy("stream").orderBy("file_no")
    files = files.select(
        "stream", "file_no", F.row_number().over(by_file).alias("pos"), F.lead("file_no").over(by_file).alias("next_file")
    )
    a, b = file_paths(df, column, kind).alias("a"), files.alias("b")
    there = a.join(b, F.col("a.stream").eqNullSafe(F.col("b.stream")) & (F.col("a.file_no") == F.col("b.file_no"))).select(
        "b.stream", "b.file_no", "b.pos", "b.next_file", "a.json_path", "a.types"
    )
    w = Window.partitionBy("stream", "json_path").orderBy("pos")
    life = there.select(
        "*", F.lag("pos").over(w).alias("was"), F.lag("types").over(w).alias("old"), F.lead("pos").over(w).alias("will")
    )
    starts = (F.col("pos") > 1) & (F.col("was").isNull() | (F.col("was") < F.col("pos") - 1))
    ends = F.col("next_file").isNotNull() & (F.col("will").isNull() | (F.col("will") > F.col("pos") + 1))
    retyped = (F.col("was") == F.col("pos") - 1) & (F.size("old") > 0) & (F.size("types") > 0) & (F.col("old") != F.col("types"))
    event = lambda cond, file, change: F.when(cond, F.struct(F.col(file).alias("file_no"), F.lit(change).alias("change")))
    log = life.select(
        "stream", "json_path",
        F.array_compact(F.array(event(starts, "file_no", "added"), event(ends, "next_file", "removed"), event(retyped, "file_no", "retyped"))).alias("events"),
    ).select("stream", "json_path", F.explode("events").alias("e"))
    return log.select(F.lit(column).alias("field"), "stream", F.col("e.file_no").cast("int").alias("file_no"), "json_path", F.col("e.change").alias("change"))


#: A number in text with separators of thousands.
THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$"
#: Type of the members that no column holds.
ENTRIES = "array<struct<path:string,value:string>>"
#: One row per column of the consistent tables: name, type, paths under which files hold it.
CONFIG_ALIASES = (
    ("strategy", "string", ("strategy", "strategy_name")),
    ("symbols", "string", ("symbols", "Symbols", "universe")),
    ("n_bootstrap", "bigint", ("n_bootstrap", "nBootstrap", "bootstrap_n")),
    ("m_baseline", "bigint", ("m_baseline", "baseline_runs")),
    ("train_window_months", "bigint", ("walk_forward.train_window_months", "walk_config.train_window_months")),
    ("test_window_months", "bigint", ("walk_forward.test_window_months", "walk_config.test_window_months")),
    ("step_months", "bigint", ("walk_forward.step_months", "walk_config.step_months", "step_months")),
    ("parameter_grid", "string", ("walk_forward.parameter_grid", "walk_config.parameter_grid")),
    ("min_trades_for_objective", "bigint", ("walk_forward.min_trades_for_objective", "walk_config.min_trades_for_objective")),
    ("embargo_days", "bigint", ("walk_forward.embargo_days", "walk_config.embargo_days")),
    ("starting_capital", "double", ("backtest_config.starting_capital", "backtest_config.capital")),
    ("commission", "string", ("backtest_config.commission",)),
    ("slippage", "string", ("backtest_config.slippage", "slippage")),
    ("realistic_fills", "boolean", ("backtest_config.realistic_fills",)),
    ("session_class", "string", ("backtest_config.session_class", "backtest_config.sessionClass")),
    ("bar_timeframe", "string", ("backtest_config.bar_timeframe",)),
    ("seed", "bigint", ("seed",)),
    ("engine_version", "string", ("engine_version",)),
    ("git_dirty", "boolean", ("git_dirty",)),
    ("tags", "string", ("tags",)),
)
GATE_ALIASES = (
    ("name", "string", ("name", "gate")),
    ("required", "string", ("required", "Required")),
    ("actual", "string", ("actual",)),
    ("deficit", "string", ("deficit", "shortfall")),
    ("waived", "boolean", ("waived",)),
    ("severity", "string", ("severity",)),
    ("basis", "double", ("basis",)),
)
TOOL_ALIASES = (
    ("name", "string", ("name",)),
    ("archetype", "string", ("archetype", "Archetype")),
    ("thesis", "string", ("thesis", "rationale")),
    ("supported_assets", "string", ("supported_assets",)),
    ("timeframes", "string", ("timeframes", "timeframe")),
    ("parameters", "string", ("parameters",)),
    ("indicators", "string", ("indicators",)),
    ("entry_long", "string", ("entry_long",)),
    ("entry_short", "string", ("entry_short",)),
    ("exit_long", "string", ("exit_long",)),
    ("exit_short", "string", ("exit_short",)),
    ("position_sizing", "string", ("position_sizing", "sizing")),
    ("notes", "string", ("notes",)),
    ("reviewed", "boolean", ("reviewed",)),
    ("confidence", "double", ("confidence",)),
)


def _is(kind: str, v: Column) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _members(v: Column, prefix: str, listed: list[str]) -> Column:
    """(path, value as JSON) of the members of an object that are not listed; an empty array for other values."""
    by_name = F.map_entries(F.try_variant_get(F.when(_is("OBJECT", v), v), "$", "map<string,variant>"))
    entry = lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("path"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))
    return F.coalesce(F.transform(F.filter(by_name, lambda e: ~e["key"].isin(listed)), entry), F.array().cast(ENTRIES))


def _whole(path: str, v: Column, cond: Column) -> Column:
    """The value v under its path, where cond holds, as an array of one."""
    return F.when(cond, F.array(F.struct(F.lit(path).alias("path"), F.to_json(v).alias("value")))).otherwise(F.array().cast(ENTRIES))


def _parts(aliases: tuple) -> dict[str, list[str]]:
    """Listed members of each section, and of the top under the empty name."""
    parts: dict[str, list[str]] = {"": []}
    for path in [p for _, _, paths in aliases for p in paths]:
        head, dot, tail = path.partition(".")
        parts.setdefault(head if dot else "", []).append(tail if dot else head)
    return parts


def _sections(df: DataFrame, aliases: tuple) -> DataFrame:
    """df with each section of the variant v as a column; a section stored as text is parsed."""
    for name in _parts(aliases):
        if name:
            x = F.try_variant_get("v", f"$.{name}", "variant")
            text = F.try_parse_json(F.when(_is("STRING", x), F.try_variant_get(x, "$", "string")))
            df = df.withColumn(f"section_{name}", F.coalesce(text, x))
    return df


def _found(path: str) -> tuple[Column, str]:
    """The variant that holds an alias and the path within it."""
    head, dot, tail = path.partition(".")
    return (F.col(f"section_{head}"), f"$.{tail}") if dot else (F.col("v"), f"$.{path}")


def _read(v: Column, path: str, kind: str) -> Column:
    """The value at the path as the column's type, cast by the type it is stored in.

    Numbers stored as text may have separators of thousands (10,000.00) and blanks around them.
    A number with a fraction is not a bigint.
    """
    value = F.try_variant_get(v, path, kind)
    if kind not in ("bigint", "double"):
        return value
    text = F.trim(F.try_variant_get(v, path, "string"))
    number = F.when(text.rlike(THOUSANDS), F.replace(text, F.lit(","), F.lit(""))).otherwise(text).try_cast("double")
    if kind == "double":
        return F.coalesce(value, number)
    return F.when(number != F.floor(number), None).otherwise(F.coalesce(value, F.when(F.abs(number) < 2.0**53, number.try_cast("bigint"))))


def unified(aliases: tuple, top: bool = True) -> list[Column]:
    """The columns of the consistent table from the variant v, as casts generated from the alias table, unread and rest.

    The first alias with a value wins.  A value that the type cannot hold is null
    in its column and is listed in unread, as (path, JSON) in order of the path; objects
    and arrays read as strings are their JSON.  rest holds, in the same form,
    what else no column holds: members that no alias names, with
    all below them, aliases whose value differs from the one that won, sections that
    are no objects (by their name) and, if ``top``, a value that is no object (as ``$``).
    Reads the columns of ``_sections``.
    """
    parts = _parts(aliases)
    columns, unread, rest = [], [], []
    for name, kind, paths in aliases:
        values = [_read(*_found(p), kind) for p in paths]
        columns.append(F.coalesce(*values).alias(name))
        for path, value in zip(paths, values):
            x = F.try_variant_get(*_found(path), "variant")
            if kind != "string":
                unread.append(_whole(path, x, value.isNull() & ~_is("VOID", x)))
        for k in range(1, len(paths)):
            other = values[k] != F.coalesce(*values[:k])
            rest.append(_whole(paths[k], F.try_variant_get(*_found(paths[k]), "variant"), other))
    for section, listed in parts.items():
        if section:
            x = F.col(f"section_{section}")
            rest += [_members(x, f"{section}.", listed), _whole(section, x, ~_is("OBJECT", x) & ~_is("VOID", x))]
    rest.append(_members(F.col("v"), "", [*parts[""], *filter(None, parts)]))
    if top:
        rest.append(_whole("$", F.col("v"), ~_is("OBJECT", F.col("v"))))
    return [*columns, F.sort_array(F.concat(*unread)).alias("unread"), F.sort_array(F.concat(*rest)).alias("rest")]


def config_table(evaluations: DataFrame) -> DataFrame:
    """evaluations.config_json of all files in one schema; invalid JSON gives a row of nulls with valid = false and an empty rest."""
    d = _sections(evaluations.select("id", "stream", "file_no", F.try_parse_json("config_json").alias("v")), CONFIG_ALIASES)
    return d.select("id", "stream", "file_no", F.col("v").isNotNull().alias("valid"), *unified(CONFIG_ALIASES))


def gates_table(evaluations: DataFrame) -> DataFrame:
    """evaluations.failed_gates, one row per element; an element that is a text is its name."""
    d = evaluations.select("id", "stream", "file_no", F.try_parse_json("failed_gates").alias("v")).where("v is not null")
    e = _exploded_pos(d, ["id", "stream", "file_no"]).withColumnRenamed("x", "v")
    text = F.when(_is("STRING", F.col("v")), F.try_variant_get("v", "$", "string"))
    name, *cols, rest = unified(GATE_ALIASES, top=False)
    other = _whole("$", F.col("v"), ~_is("OBJECT", F.col("v")) & ~_is("STRING", F.col("v")))
    return e.select("id", "stream", "file_no", "pos", F.coalesce(name, text).alias("name"), *cols, F.concat(rest, other).alias("rest"))


def _exploded_pos(df: DataFrame, keep: list[str]) -> DataFrame:
    return _lateral(df, f"{', '.join(keep)}, e.pos as pos, e.value as x", "if(schema_of_variant(v) like 'ARRAY%', v, null)")


def tool_table(logs: DataFrame) -> DataFrame:
    """generation_logs.raw_tool_input of all files in one schema; invalid JSON as in config_table."""
    d = logs.select("log_id", "stream", "file_no", F.try_parse_json("raw_tool_input").alias("v"))
    return d.select("log_id", "stream", "file_no", F.col("v").isNotNull().alias("valid"), *unified(TOOL_ALIASES))


def all_changes(evaluations: DataFrame, logs: DataFrame) -> DataFrame:
    """Every field change of the three JSON columns."""
    return (
        field_changes(evaluations, "config_json", NESTED)
        .unionByName(field_changes(evaluations, "failed_gates", ELEMENTS))
        .unionByName(field_changes(logs, "raw_tool_input", MEMBERS))
    )
