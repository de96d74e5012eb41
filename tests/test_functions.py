import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from skygauge.functions import scalars as C, severity as S, units as U


def t():
    return F.col("t")


def test_units(one):
    assert one(U.c_to_f(t()), "t double", [0.0, 100.0, None]) == [32.0, 212.0, None]
    assert one(U.kelvin_to_c(t()), "t double", [273.15]) == [0.0]
    assert one(U.kph_to_mps(t()), "t double", [36.0]) == [10.0]
    assert one(U.f_to_c(t()), "t double", [212.0]) == [100.0]


def test_heat_index_only_above_80(one):
    rows = [(80.0, 50.0), (80.0001, 50.0), (95.0, None), (None, 50.0), (95.0, 50.0)]
    out = one(U.heat_index_f(F.col("t"), F.col("h")), "t double, h double", rows)
    assert out[0] is None and out[2] is None and out[3] is None
    assert out[1] == pytest.approx(80.8, abs=0.5)
    assert out[4] == pytest.approx(105.2, abs=0.2)  # published heat index table: 105


def test_thermal_severity_edges(one):
    temps = [35.0, 35.1, 30.0, 30.1, 0.0, -0.1, -10.0, -10.1, None, float("nan")]
    assert one(S.thermal_severity(t()), "t double", temps) == [
        "moderate", "high", "normal", "moderate", "normal", "moderate", "moderate", "high",
        "normal", "normal",
    ]


def test_condition_severity(one):
    texts = ["TORNADO warning", "light snow", "Overcast", "Clear", None, "rain with thunderstorm", "Partly Cloudy"]
    assert one(S.condition_severity(F.col("c")), "c string", texts) == [
        "severe", "moderate", "mild", "normal", "normal", "severe", "mild",
    ]


def test_combined_severity(one):
    rows = [(20.0, "Flood alert"), (20.0, "Light Rain"), (36.0, "rain"), (32.0, "clear"), (20.0, None)]
    both = F.concat_ws(
        "/", S.combined_severity(F.col("t"), F.col("d")),
        S.combined_severity(F.col("t"), F.col("d"), promote=False),
    )
    assert one(both, "t double, d string", rows) == [
        "high/high", "moderate/normal", "high/high", "moderate/moderate", "normal/normal",
    ]


def test_icons_and_bands(one):
    texts = ["Sunny", "Cloudy", "Drizzle", "Snow", "Thunder", "Mist", "Haze", None]
    assert one(S.weather_icon(F.col("c")), "c string", texts) == ["☀️", "☁️", "🌧️", "❄️", "⛈️", "🌫️", "🌤️", "🌤️"]
    temps = [-0.1, 0.0, 10.0, 20.0, 30.0, float("nan")]
    assert one(S.temperature_band(t()), "t double", temps) == [
        "#9ec5fe", "#6ea8fe", "#a3cfbb", "#ffda6a", "#ea868f", "#ea868f",
    ]


def test_safe_double_follows_float(one):
    texts = [" 12.5 ", "1_000", "abc", "", "1e3", "+.5", "5.", "nan", "+NaN", "-inf", "Infinity",
             "12d", "0x10", "1__0", "_1", "--1", "1e", None, "true"]

    def expected(text):
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    for text, got in zip(texts, one(C.safe_double("t"), "t string", texts)):
        want = expected(text)
        assert got == want or (math.isnan(want) and math.isnan(got)), text


def test_event_ts(one):
    texts = ["2024-03-01T12:00:00", "2024-03-01T12:00:00Z", "2024-03-01T12:00:00.5+02:00", "2024-03-01",
             "2024-03-01 12:00", "2024", "soon", None, "2024-13-01"]
    noon = 1709294400000.0
    assert one(C.event_ts_ms(F.col("t")), "t string", texts) == [
        noon, noon, noon - 7200000 + 500, noon - 43200000, noon, None, None, None, None,
    ]


def test_event_ts_ignores_session_zone(spark, one):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        stamp = C.event_ts(F.col("t"))
        assert one(F.unix_seconds(stamp), "t string", ["1970-01-01T00:00:10"]) == [10]
        assert one(C.iso_utc(stamp), "t string", ["2024-07-01T01:00:00"]) == ["2024-07-01T01:00:00.000000Z"]
        assert one(C.utc_date(stamp).cast("string"), "t string", ["2024-07-01T01:00:00"]) == ["2024-07-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_text_helpers(one):
    assert one(C.slug(F.col("t")), "t string", ["Mexico City", None]) == ["mexico_city", "unknown"]
    assert one(C.capitalize(F.col("t")), "t string", ["sEVERE", ""]) == ["Severe", ""]
    assert one(C.num_or_zero("t"), "t string", ["3.5", "x", None, "nan"]) == [3.5, 0.0, 0.0, 0.0]
    assert one(C.temperature_size(t()), "t double", [-12.0, 3.0]) == [12.0, 5.0]
    assert one(C.finite_or_null(t()), "t double", [1.0, float("nan"), float("-inf")]) == [1.0, None, None]


finite = st.floats(allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(finite.filter(lambda x: abs(x) < 1e12), min_size=200, max_size=200))
def test_fmt1_matches_python(one, values):
    values += [12.25, 12.35, 0.05, -0.04, 0.25, 99.95, 1e11 + 0.25]
    assert one(C.fmt1(t()), "t double", values) == [f"{v:.1f}" for v in values]


def test_number_text_matches_python(one):
    values = [868.0, 1e7, 123456789.125, 1e15, 1e16, 1.5e-5, 0.0001, 0.00025, -75.5, 1e22, 12345.678, 2e-7,
              float("inf"), 1e100]
    assert one(C.number_text("t"), "t double", values) == [repr(v) for v in values]
