import json

from skygauge.operators import normalize as N

OPENWEATHER = {
    "name": "Oulu", "sys": {"country": "FI"}, "main": {"temp": -3.25, "humidity": 91, "pressure": 996},
    "wind": {"speed": 7.75, "deg": 15}, "weather": [{"main": "Snow", "description": "light sleet"}, {"main": "Mist"}],
    "clouds": {"all": 88}, "coord": {"lat": 65.01, "lon": 25.47},
}
WEATHERAPI = {
    "location": {"name": "Quito", "country": "Ecuador", "lat": -0.22, "lon": -78.51},
    "current": {
        "temp_c": 13.5, "humidity": 67, "pressure_mb": 1026, "wind_kph": 9, "wind_degree": 120,
        "condition": {"text": "Patchy rain nearby"}, "cloud": 61,
    },
}


def payloads(spark, *rows):
    return spark.createDataFrame([(s, json.dumps(p)) for s, p in rows], "source string, payload string")


def test_openweather(spark):
    r = N.normalize_openweather(payloads(spark, ("x", OPENWEATHER)), defaults=True, source="openweather").first()
    assert (r.source, r.city, r.country) == ("openweather", "Oulu", "FI")
    assert (r.temperature, r.humidity, r.pressure, r.wind_speed, r.wind_direction) == (-3.25, 91, 996, 7.75, 15)
    assert (r.weather_condition, r.weather_description, r.clouds) == ("Snow", "light sleet", 88)
    assert tuple(r.coordinates) == (65.01, 25.47) and json.loads(r.raw_data) == OPENWEATHER
    assert r.timestamp.endswith("Z") and r._corrupt is None


def test_weatherapi(spark):
    rows = payloads(spark, ("x", WEATHERAPI))
    r = N.normalize_weatherapi(rows, wind_to_mps=False).first()
    assert (r.source, r.city, r.country) == ("weatherapi", "Quito", "Ecuador")
    assert (r.temperature, r.humidity, r.pressure, r.wind_speed, r.wind_direction) == (13.5, 67, 1026, 9, 120)
    assert r.weather_condition == r.weather_description == "Patchy rain nearby" and r.clouds == 61
    assert N.normalize_weatherapi(rows).first().wind_speed == 9 / 3.6


def test_faulty_payloads(spark):
    texts = ["{broken", None, "[1]", '{"main": {"temp": "15.5", "humidity": "wet", "pressure": null}}', "{}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    for filled in (True, False):
        got = {r.i: r for r in N.normalize_openweather(frame, defaults=filled, keep=["i"]).collect()}
        for i in (0, 1, 2):
            assert (got[i].temperature, got[i].city, got[i].weather_condition) == (None, None, None)
        assert [got[i]._corrupt for i in range(5)] == ["{broken", None, "[1]", None, None]
        assert (got[3].temperature, got[3].humidity, got[3].pressure) == (15.5, None, None)
        assert (got[3].city, got[3].clouds, got[4].temperature) == (("Unknown", 0.0, 0.0) if filled else (None, None, None))


def test_request_names_units_and_gaps(spark):
    rows = payloads(spark, ("x", {"main": {"temp": 300.0}})).selectExpr("*", "'Paris' AS c", "'FR' AS k")
    r = N.normalize_openweather(rows, city_col="c", country_col="k", temp_unit="kelvin").first()
    assert (r.city, r.country, r.humidity, r.weather_condition) == ("Paris", "FR", None, None)
    assert abs(r.temperature - 26.85) < 1e-9
    d = N.normalize_openweather(payloads(spark, ("x", {})), defaults=True).first()
    assert (d.city, d.temperature, d.weather_condition, tuple(d.coordinates)) == ("Unknown", 0.0, "Unknown", (0.0, 0.0))


def test_unknown_sources(spark):
    rows = payloads(spark, ("openweathermap", OPENWEATHER), ("weatherapi", WEATHERAPI), ("other", {"a": 1}), (None, {}))
    assert {r.source for r in N.normalize(rows).collect()} == {"openweathermap", "weatherapi"}
    kept = {r.source: r for r in N.normalize(rows, unknown="keep", defaults=False).collect()}
    assert kept["other"].raw_data == '{"a": 1}' and kept["other"].city is None
    assert kept["other"].coordinates is None and None in kept and kept["weatherapi"].raw_data is None


def test_union_and_flatten(spark):
    a = spark.createDataFrame([(1, "x")], "id int, city string")
    b = spark.createDataFrame([(2, (1.0, None))], "id int, coordinates struct<lat double, lon double>")
    rows = {r.id: r for r in N.flatten_coordinates(N.union_sources([a, b])).collect()}
    assert (rows[1].lat, rows[1].lon, rows[2].lat, rows[2].lon, rows[2].city) == (0.0, 0.0, 1.0, 0.0, None)


def test_typed_and_lenient_reads_agree(spark):
    """Odd values give what the lenient rules say, whether or not the rest of the payload is of its type."""
    inf = float("inf")
    odd = [
        ("1", 1.0), ("-0.5e1", -5.0), ("1e400", inf), ("12345678901234567890", 12345678901234567890.0), ("0.1", 0.1), ('"15.5"', 15.5),
        ('" 7 "', 7.0), ('"1_000"', 1000.0), ('"12d"', None), ('"0x1p3"', None), ('"inf"', inf), ('"-Infinity"', -inf),
        ("true", None), ("null", None), ("[1]", None), ('{"v": 1}', None), ('""', None), ('"wet"', None),
    ]
    rows = []
    for i, (text, _) in enumerate(odd):
        for j, other in enumerate(("4", '"4"', "null", "[]", '"x"')):
            rows.append((10 * i + j, f'{{"name": 5, "main": {{"temp": {text}, "humidity": {other}}}, "weather": [{{"main": "Fog"}}]}}'))
    got = {r.i: r for r in N.normalize_openweather(spark.createDataFrame(rows, "i int, payload string"), keep=["i"]).collect()}
    for i, (text, want) in enumerate(odd):
        for j, humidity in enumerate((4.0, 4.0, None, None, None)):
            r = got[10 * i + j]
            assert (r.temperature, r.humidity, r.city, r.weather_condition, r._corrupt) == (want, humidity, "5", "Fog", None), (text, j)
    shapes = {
        '{"main": 5, "name": "A"}': ("A", None), '{"weather": {}, "name": "A", "main": {"temp": 2}}': ("A", 2.0),
        '{"name": {"a": 1}, "main": {"temp": 2}}': ('{"a":1}', 2.0), '{"main": {"temp": 1, "temp": 2}}': (None, 2.0),
        '{"main": {"temp": "nan"}}': (None, "nan"), '{"main": null}': (None, None), '{"weather": [], "main": {"temp": 3}}': (None, 3.0),
    }
    frame = spark.createDataFrame([(t,) for t in shapes], "payload string")
    for r in N.normalize_openweather(frame, keep=["payload"]).collect():
        city, temperature = shapes[r.payload]
        assert r.city == city and (r.temperature == temperature or str(r.temperature) == temperature), r
