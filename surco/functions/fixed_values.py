"""Fixed values that the results depend on."""

# Sky description by weather code.
SKY_BY_WEATHER_CODE = {
    0: "Despejado",
    1: "Mayormente despejado",
    2: "Parcialmente nublado",
    3: "Nublado",
    45: "Niebla",
    48: "Niebla con escarcha",
    51: "Llovizna ligera",
    53: "Llovizna moderada",
    55: "Llovizna intensa",
    61: "Lluvia ligera",
    63: "Lluvia moderada",
    65: "Lluvia intensa",
    71: "Nieve ligera",
    73: "Nieve moderada",
    75: "Nieve intensa",
    80: "Chubascos ligeros",
    81: "Chubascos moderados",
    82: "Chubascos intensos",
    95: "Tormenta",
    96: "Tormenta con granizo ligero",
    99: "Tormenta con granizo intenso",
}

# Registry name of a sensor type -> name used in the readings.
SENSOR_NAMES = {
    "temperature": "temperatura",
    "ambient_humidity": "humedad_ambiental",
    "soil_moisture": "humedad_suelo",
}

# Device class of a home device -> registry sensor type.
DEVICE_CLASSES = {
    "moisture": "soil_moisture",
    "temperature": "temperature",
    "humidity": "ambient_humidity",
}

# Domains of devices that can be switched.
SWITCHABLE_DOMAINS = ("switch", "valve", "light", "input_boolean")

# Device states that carry no reading.
MISSING_STATES = ("unavailable", "unknown")

# Metrics of a reading.
METRICS = ("temperatura", "humedad_ambiental", "humedad_suelo")

# Entity types that can be read or acted on.
ENTITY_TYPES = ("parcela", "invernadero", "planta")

# Registry sensor types.
SENSOR_TYPES = ("soil_moisture", "temperature", "ambient_humidity", "valve")

# Farmer actions and the state field each one updates.
ACTION_FIELDS = {
    "riego": "ultimo_riego",
    "abonado": "ultimo_abonado",
    "poda": "ultima_poda",
}

# Growth phase -> coefficient column of the crop reference.
PHASE_COLUMNS = {
    "inicial": "kc_inicio",
    "desarrollo": "kc_desarrollo",
    "mediados": "kc_medio",
    "final": "kc_final",
}

# Compass sectors counter-clockwise from east.
COMPASS = ("Este", "Noreste", "Norte", "Noroeste", "Oeste", "Suroeste", "Sur", "Sureste")

# Safety distance in metres where a relation names none.
DEFAULT_SAFETY_M = 500.0

# Half the side of the web mercator square in metres.
MERCATOR_HALF_M = 20037508.342789244

# WGS-84 ellipsoid and mean earth radius in metres.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6371008.8

# Daily weather variables -> column names of the daily series.
DAILY_NAMES = {
    "temperature_2m_max": "temp_max_c",
    "temperature_2m_min": "temp_min_c",
    "temperature_2m_mean": "temp_media_c",
    "precipitation_sum": "precipitacion_mm",
    "rain_sum": "lluvia_mm",
    "relative_humidity_2m_mean": "humedad_rel_pct",
    "wind_speed_10m_max": "viento_max_kmh",
    "wind_speed_10m_mean": "viento_medio_kmh",
    "shortwave_radiation_sum": "radiacion_solar_mjm2",
    "et0_fao_evapotranspiration": "et0_mm",
}

# Forecast variables -> columns of the forecast table.
FORECAST_NAMES = {
    "temperature_2m_max": "tmax",
    "temperature_2m_min": "tmin",
    "precipitation_sum": "precipitacion_mm",
    "rain_sum": "lluvia_mm",
    "precipitation_probability_max": "prob_precipitacion",
    "wind_speed_10m_max": "viento_velocidad",
    "wind_direction_10m_dominant": "viento_direccion",
    "wind_gusts_10m_max": "racha_max",
    "uv_index_max": "uv_max",
    "et0_fao_evapotranspiration": "et0_evapotranspiracion",
    "shortwave_radiation_sum": "radiacion_solar",
    "weather_code": "weather_code",
    "relative_humidity_2m_max": "humedad_max",
    "relative_humidity_2m_min": "humedad_min",
}

# Hourly soil variables -> columns of the daily series.
SOIL_NAMES = {
    "soil_moisture_0_to_7cm": "humedad_suelo_m3m3",
    "soil_temperature_0cm": "temp_suelo_c",
}

# Provenance labels of a daily row.
SOURCE_HISTORY = "historico_era5"
SOURCE_FORECAST = "forecast"
SOURCE_OBSERVED = "observado_modelo"

# White space that separates words, as a pattern and as a set of characters.
WHITE_SPACE = r"(?U)[\s\x1C-\x1F]+"
WHITE_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)
