"""Word lists, thresholds, coefficients and defaults.

These decide results and must stay exactly as they are.
"""

# Sources that readings carry.
OPENWEATHER = "openweathermap"
OPENWEATHER_LEGACY = "openweather"
WEATHERAPI = "weatherapi"
STATION = "weather_station"

# Kafka topics.
RAW_TOPIC = "weather-raw-data"
PROCESSED_TOPIC = "weather-processed-data"

# Numeric features used by quality checks, anomaly detection and metric charts.
FEATURES = ("temperature", "humidity", "pressure", "wind_speed")

# Heat index in Fahrenheit: (coefficient, power of temperature, power of humidity).
# Applies above HEAT_INDEX_MIN_F only.
HEAT_INDEX_MIN_F = 80.0
HEAT_INDEX_TERMS = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
)

# Severity by condition text, first level that matches; otherwise "normal".
CONDITION_SEVERITY = (
    ("severe", ("thunderstorm", "tornado", "hurricane", "blizzard")),
    ("moderate", ("rain", "snow", "drizzle", "fog", "mist", "shower")),
    ("mild", ("cloudy", "overcast", "partly cloudy")),
)
SEVERITY_LEVELS = ("normal", "mild", "moderate", "severe")

# Severity by temperature and description.
DESCRIPTION_HIGH = ("storm", "hurricane", "tornado", "blizzard", "flood", "severe")
DESCRIPTION_MODERATE = ("rain", "snow", "wind", "fog", "mist", "drizzle")
VERY_HOT_C, HOT_C, FREEZING_C, VERY_COLD_C = 35.0, 30.0, 0.0, -10.0

# Dashboard icon by condition text, first match; otherwise the default.
CONDITION_ICONS = (
    (("clear", "sunny"), "☀️"),
    (("cloud", "overcast"), "☁️"),
    (("rain", "drizzle"), "🌧️"),
    (("snow",), "❄️"),
    (("storm", "thunder"), "⛈️"),
    (("fog", "mist"), "🌫️"),
)
DEFAULT_ICON = "🌤️"

# Dashboard colour by temperature: colour below each limit, last one beyond.
TEMPERATURE_COLOURS = (
    (0.0, "#9ec5fe"),
    (10.0, "#6ea8fe"),
    (20.0, "#a3cfbb"),
    (30.0, "#ffda6a"),
)
HOT_COLOUR = "#ea868f"

# Data quality rules.
REQUIRED_FIELDS = (
    "timestamp", "source", "city", "country",
    "temperature", "humidity", "pressure", "wind_speed",
)
BOUNDS = {
    "temperature": (-60.0, 60.0),
    "humidity": (0.0, 100.0),
    "pressure": (870.0, 1085.0),
    "wind_speed": (0.0, 75.0),
}

# Rolling z-score.
ZSCORE_WINDOW = 240
ZSCORE_THRESHOLD = 3.5
ZSCORE_MIN_SAMPLES = 30
ZSCORE_FLAT_SD = 1e-12

# Isolation Forest.
IFOREST_TREES = 200
IFOREST_CONTAMINATION = 0.01
IFOREST_MIN_SAMPLES = 200
IFOREST_SEED = 42
IFOREST_MAX_SAMPLES = 256

# Stream metrics.
METRIC_WINDOW_MESSAGES = 25
METRIC_MIN_SECONDS = 1e-6

# Fields a processed record needs before the dashboard shows it.
DASHBOARD_FIELDS = ("city", "temperature", "humidity", "wind_speed")

# Retention of raw and processed data: files older than 30 whole days go,
# so a record stays while it is younger than 31 days.
RETENTION_DAYS = 30
