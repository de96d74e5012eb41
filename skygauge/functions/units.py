"""Unit conversions and the heat index as column expressions."""

from functools import reduce
from operator import add, mul

from pyspark.sql import Column, functions as F

from skygauge import fixed_values as V


def kelvin_to_c(c: Column) -> Column:
    return c - F.lit(273.15)


def kph_to_mps(c: Column) -> Column:
    return c / F.lit(3.6)


def c_to_f(c: Column) -> Column:
    return c * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def f_to_c(c: Column) -> Column:
    return (c - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def heat_index_f(temp_f: Column, humidity: Column) -> Column:
    """Regression over temperature (F) and humidity (%); NULL up to 80 F."""
    terms = [
        reduce(mul, [temp_f] * t_pow + [humidity] * h_pow, F.lit(coefficient))
        for coefficient, t_pow, h_pow in V.HEAT_INDEX_TERMS
    ]
    hot = (temp_f > V.HEAT_INDEX_MIN_F) & ~F.isnan(temp_f)
    return F.when(hot, reduce(add, terms))
