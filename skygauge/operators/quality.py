"""Data quality: required fields, numeric types, plausibility bounds.

Checks run on the JSON text, where an absent key and a null are different things. They
are written as SQL text: one expression per check, parsed by Spark in one go.
"""

from pyspark.sql import Column, DataFrame, functions as F

from skygauge import fixed_values as V
from skygauge.functions.scalars import iso_utc, number_text_sql, safe_double_sql

_CORRUPT = "_corrupt"


def _once(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Add a column that is computed once per row, however often it is used.

    A generator over one element stops the optimizer from copying the expression into
    every filter and projection above it. Within a lambda the expression stays out of the stage's
    generated method, which the checks would make too long for the JVM to compile.
    """
    return df.select("*", F.expr(f"explode(transform(array(0), _one -> {sql}))").alias(name))


def _strict(function: str, json: str) -> str:
    """A JSON function that refuses a bare NaN or Infinity, with these quoted if needed.

    A token is bare if only whole strings and other characters follow it.
    """
    rest = r'(?:[^"\\\\]++|"(?:[^"\\\\]++|\\\\.)*+")*+$'
    quoted = f"""regexp_replace({json}, '(NaN|-?Infinity)(?={rest})', '"$1"')"""
    return f"coalesce({function}({json}), {function}({quoted}))"


def _shape(json: str, field: str) -> str:
    """Type of a field's value; parses the event again, so for rare cases only."""
    event = _strict("try_parse_json", json)
    return f"schema_of_variant(try_variant_get({event}, '$.{field}', 'variant'))"


def _number(json: str, field: str) -> str:
    """What Python's float() makes of a value; a boolean counts as 0 or 1.

    The parser hands a bare NaN or Infinity over in quotes.
    """
    text = f"_event.`{field}`"
    bare = f"""regexp_extract({text}, '^"(NaN|-?Infinity)"$', 1)"""
    return f"""CASE
      WHEN {text} IN ('true', 'false') AND {_shape(json, field)} = 'BOOLEAN' THEN double({text} = 'true')
      WHEN startswith({text}, '"') THEN {safe_double_sql(bare)} ELSE {safe_double_sql(text)} END"""


def _required(json: str, field: str) -> str:
    keys = _strict("json_object_keys", json)
    return f"""CASE WHEN _event.`{field}` IS NULL THEN
      CASE WHEN array_contains({keys}, '{field}') THEN 'null_value' ELSE 'missing_field' END END"""


def _numeric(field: str, bounds) -> str:
    """A value that is absent or null is no issue here. NaN lies within any bounds:
    comparisons with it are false, though Spark orders it last."""
    text, n, (low, high) = f"_event.`{field}`", f"_numbers.`{field}`", bounds or (None, None)
    outside = "false" if low is None or high is None else (
        f"NOT isnan({n}) AND ({n} < {float(low)!r}D OR {n} > {float(high)!r}D)"
    )
    return f"""CASE WHEN {text} IS NOT NULL AND {n} IS NULL THEN 'type_mismatch'
      WHEN {outside} THEN 'out_of_bounds' END"""


def _issue(json: str, position: int, field: str, bounds) -> str:
    """The issue a check found, with its message, or NULL."""
    kind, name = f"_kinds[{position}]", f"`{field}`"
    shape = _shape(json, field)
    given = f"""CASE WHEN startswith({shape}, 'OBJECT') THEN 'dict'
      WHEN startswith({shape}, 'ARRAY') THEN 'list' ELSE 'str' END"""
    if bounds is None:
        message = f"""CASE WHEN {kind} = 'missing_field' THEN 'Required field {name} is missing.'
          ELSE 'Required field {name} is null.' END"""
    else:
        limits = "[{}, {}]".format(*bounds)
        message = f"""CASE WHEN {kind} = 'type_mismatch' THEN 'Expected numeric for {name}, got ' || {given} || '.'
          ELSE '{name}=' || {number_text_sql(f"_numbers.`{field}`")} || ' outside {limits}' END"""
    return f"""CASE WHEN {kind} IS NOT NULL THEN
      named_struct('type', {kind}, 'field', '{field}', 'message', {message}) END"""


def validate(
    df: DataFrame, json_col: str = "value", required=V.REQUIRED_FIELDS, bounds=None,
    numeric=V.FEATURES,
) -> DataFrame:
    """Adds ``issues`` and ``data_quality {passed, issue_count}``.

    Issues come in a fixed order: required fields as listed, then the numeric fields.
    Text that is no JSON object cannot be validated: both columns are NULL there.
    The event itself is not changed, and no row is dropped.

    Only the checked fields are parsed, as text. What is rare is looked up when it
    occurs: whether an empty field is absent or null, and the type of a value that is no
    number. Messages are put together for checks that found something.
    """
    bounds = V.BOUNDS if bounds is None else bounds
    json = f"`{json_col}`"
    fields = list(dict.fromkeys([*required, *numeric]))
    schema = ", ".join(f"`{f}` string" for f in fields) + f", {_CORRUPT} string"
    options = f"map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{_CORRUPT}')"
    numbers = ", ".join(f"'{f}', {_number(json, f)}" for f in numeric)
    kinds = [_required(json, f) for f in required] + [_numeric(f, bounds.get(f)) for f in numeric]
    checks = [(f, None) for f in required]
    checks += [(f, tuple(bounds.get(f) or (None, None))) for f in numeric]
    issues = ", ".join(_issue(json, i, f, b) for i, (f, b) in enumerate(checks))

    out = _once(df, "_event", f"from_json({json}, '{schema}', {options})")
    out = _once(out, "_numbers", f"named_struct({numbers})")
    out = _once(out, "_kinds", f"""CASE WHEN _event IS NOT NULL AND _event.{_CORRUPT} IS NULL
      THEN array({', '.join(kinds)}) END""")
    out = _once(out, "issues", f"CASE WHEN _kinds IS NOT NULL THEN array_compact(array({issues})) END")
    return out.withColumn("data_quality", quality_flag(F.col("issues"))).drop(
        "_event", "_numbers", "_kinds"
    )


def quality_flag(issues: Column) -> Column:
    return F.when(issues.isNotNull(), F.struct(
        (F.size(issues) == 0).alias("passed"), F.size(issues).alias("issue_count")
    ))


def quality_events(df: DataFrame, now=None, timestamp: str = "timestamp") -> DataFrame:
    """One record per event with issues, for the quality log."""
    stamp = iso_utc(F.current_timestamp()) if now is None else F.lit(now)
    return df.where(F.size("issues") > 0).select(
        stamp.alias("ts_utc"), "city", "source",
        F.col(timestamp).alias("event_timestamp"), "issues",
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """Issue counts by city, source, type and field; combined map-side."""
    return (
        df.select("city", "source", F.explode("issues").alias("i"))
        .groupBy("city", "source", F.col("i.type").alias("type"), F.col("i.field").alias("field"))
        .agg(F.count(F.lit(1)).alias("issue_count"))
    )
