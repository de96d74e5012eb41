"""Lenient parsing, time and text helpers as column expressions.

Nothing here depends on the session time zone: text without a zone is UTC.
"""

from pyspark.sql import Column, functions as F

_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_ISO_TIME = r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
_ISO_ZONE = r"[T ].*(Z|[+-][0-9]{2}:[0-9]{2})$"


def safe_double_sql(x: str) -> str:
    """Number in a text as double, NULL if it is none; ``x`` is SQL.

    Accepts surrounding blanks, digit-group underscores, exponents, nan and inf,
    but not the type suffixes or hex forms that a plain cast would take. Text made of
    digits, signs and exponents goes straight to the cast.
    """
    text = f"trim(CAST({x} AS STRING))"
    grouped = f"regexp_replace({text}, '(?<=[0-9])_(?=[0-9])', '')"
    number = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    return f"""try_cast(CASE WHEN {text} RLIKE '^[-+0-9.eE]+$' THEN {text}
      WHEN {grouped} RLIKE '{number}' THEN {grouped}
      WHEN {text} RLIKE '^(?i)[+-]?(nan|inf|infinity)$'
        THEN regexp_replace({text}, '(?i)^[+-](?=nan)', '') END AS DOUBLE)"""


def safe_double(x: str) -> Column:
    """``safe_double_sql`` of a column name or SQL text, as a column."""
    return F.expr(safe_double_sql(x))


def event_ts(c: Column) -> Column:
    """ISO-8601 text as TIMESTAMP; no zone means UTC; NULL if not parseable."""
    valid = F.rlike(c, F.lit(_ISO_DATE + _ISO_TIME))
    full = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00"))).otherwise(
        F.regexp_replace(c, "([T ][0-9]{2}:[0-9]{2})(?=$|Z|[+-])", "$1:00")
    )
    zoned = F.when(F.rlike(c, F.lit(_ISO_ZONE)), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(valid, F.try_to_timestamp(zoned))


def event_ts_ms(c: Column) -> Column:
    """ISO-8601 text as epoch milliseconds (double, with microseconds)."""
    return F.unix_micros(event_ts(c)) / F.lit(1000.0)


def utc_text(ts: Column, pattern: str) -> Column:
    """Format a TIMESTAMP in UTC, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def iso_utc(ts: Column) -> Column:
    return utc_text(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_date(ts: Column) -> Column:
    """Calendar day in UTC, the partition column of the processed zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def slug(c: Column) -> Column:
    """Lower case with underscores; NULL becomes ``unknown``."""
    return F.replace(F.lower(F.coalesce(c, F.lit("unknown"))), F.lit(" "), F.lit("_"))


def temperature_size(temp: Column) -> Column:
    """Marker size of a temperature on the map: at least 5."""
    return F.greatest(F.abs(temp), F.lit(5.0))


def num_or_zero(x: str) -> Column:
    """Number for a chart from a column name or SQL text; anything else, NaN too, is 0."""
    return F.nanvl(F.coalesce(safe_double(x), F.lit(0.0)), F.lit(0.0))


def fmt1(c: Column) -> Column:
    """One decimal, as shown in report tables.

    Rounds the exact binary value, ties to even; the JVM formatter rounds the shortest
    decimal text half up, which differs for values like 12.25 and 12.35.
    """
    c = c.cast("double")
    tens = c * F.lit(10.0)
    # Exact error of the product, from the high and low half of the significand.
    high = c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)
    error = (high * 10.0 - tens) + (c - high) * 10.0
    tie = F.abs(tens - F.floor(tens)) == 0.5
    rounded = F.when(tie & (error > 0), F.ceil(tens).cast("double")).when(
        tie & (error < 0), F.floor(tens).cast("double")
    ).otherwise(F.rint(tens))
    exact = F.abs(c) < 1e14
    return F.when(c.isNotNull(), F.format_string("%.1f", F.when(exact, rounded / 10.0).otherwise(c)))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def number_text_sql(x: str) -> str:
    """Shortest decimal text of a double in the notation Python users know; ``x`` is SQL.

    Spark writes 1.0E7 where this gives 10000000.0; exponents start at 1e16
    and below 1e-4.
    """
    text = f"CAST(abs({x}) AS STRING)"
    mantissa = f"substring_index({text}, 'E', 1)"
    exponent = f"try_cast(substring_index({text}, 'E', -1) AS INT)"
    digits = f"regexp_replace(replace({mantissa}, '.', ''), '(?<=[0-9])0+$', '')"
    tail = f"substr({digits}, {exponent} + 2)"
    size = f"CAST(abs({exponent}) AS STRING)"
    return f"""CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE
      WHEN isnan({x}) THEN 'nan' WHEN abs({x}) = double('inf') THEN 'inf'
      WHEN NOT contains({text}, 'E') THEN {text}
      WHEN {exponent} BETWEEN 0 AND 15 THEN rpad(left({digits}, {exponent} + 1), {exponent} + 1, '0')
        || '.' || CASE WHEN {tail} = '' THEN '0' ELSE {tail} END
      WHEN {exponent} BETWEEN -4 AND -1 THEN '0.' || repeat('0', -{exponent} - 1) || {digits}
      ELSE regexp_replace({mantissa}, '[.]0$', '') || 'e' || CASE WHEN {exponent} < 0 THEN '-' ELSE '+' END
        || lpad({size}, greatest(length({size}), 2), '0') END"""


def number_text(x: str) -> Column:
    """``number_text_sql`` of a column name or SQL text, as a column."""
    return F.expr(number_text_sql(x))
