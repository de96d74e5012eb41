"""Severity levels, icons and colour bands as column expressions."""

import re

from pyspark.sql import Column, functions as F

from skygauge import fixed_values as V


def _mentions(text: Column, words) -> Column:
    """True if any word occurs in the text; NULL text mentions nothing.

    One expression for all words: generated code that is long is not compiled by the JVM.
    """
    return F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join(map(re.escape, words))))


def condition_severity(condition: Column) -> Column:
    """severe / moderate / mild / normal by words in the condition."""
    (first, words), *rest = V.CONDITION_SEVERITY
    out = F.when(_mentions(condition, words), first)
    for level, words in rest:
        out = out.when(_mentions(condition, words), level)
    return out.otherwise("normal")


def thermal_severity(temp: Column) -> Column:
    """high / moderate / normal by temperature in C; NULL and NaN are normal."""
    temp = F.nanvl(temp, F.lit(None).cast("double"))
    return (
        F.when((temp > V.VERY_HOT_C) | (temp < V.VERY_COLD_C), "high")
        .when((temp > V.HOT_C) | (temp < V.FREEZING_C), "moderate")
        .otherwise("normal")
    )


def combined_severity(temp: Column, description: Column, promote: bool = True) -> Column:
    """Thermal level, raised by words in the description.

    With ``promote=False`` moderate words leave a normal level as it is, which is
    what a comparison of the level names as strings gives.
    """
    base = thermal_severity(temp)
    out = F.when(_mentions(description, V.DESCRIPTION_HIGH) | (base == "high"), "high")
    if promote:
        out = out.when(_mentions(description, V.DESCRIPTION_MODERATE), "moderate")
    return out.otherwise(base)


def weather_icon(condition: Column) -> Column:
    (words, icon), *rest = V.CONDITION_ICONS
    out = F.when(_mentions(condition, words), icon)
    for words, icon in rest:
        out = out.when(_mentions(condition, words), icon)
    return out.otherwise(V.DEFAULT_ICON)


def temperature_band(temp: Column) -> Column:
    """Colour of a temperature; NULL counts as 0, NaN is beyond every limit."""
    temp = F.coalesce(temp, F.lit(0.0))
    (limit, colour), *rest = V.TEMPERATURE_COLOURS
    out = F.when(temp < limit, colour)
    for limit, colour in rest:
        out = out.when(temp < limit, colour)
    return out.otherwise(V.HOT_COLOUR)
