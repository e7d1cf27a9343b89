"""Declared schemas of the tables and messages, as DDL."""

MESSAGE = (
    "attrs map<string,string>, data binary, publish_ts timestamp, message_id string"
)

READING_BODY = (
    "valor string, unidad string, sensor_entity_id string, timestamp_lectura string"
)

PUSHED_BODY = (
    "sensor_id string, sensor_type string, parcela_usuario_id string, "
    "user_id string, value string, timestamp string"
)

POSITION_BODY = "user_id string, coordinates string, timestamp string"

FIELD_READINGS = (
    "user_id string, parcel_id string, nombre string, timestamp timestamp_ntz, "
    "temperatura double, humedad_ambiental double, humedad_suelo double, "
    "precipitacion_mm double, et0 double, radiacion_solar double, "
    "fuente_temperatura string, tipo_cultivo string, variedad string, "
    "fecha_plantacion_aprox date, estado_cielo string, sensor_id string"
)

PLANT_READINGS = (
    "user_id string, greenhouse_id string, plant_id string, timestamp timestamp_ntz, "
    "temperatura double, humedad_ambiental double, humedad_suelo double, "
    "tipo_cultivo string, variedad string, fecha_plantacion date"
)

ACTIONS = (
    "user_id string, entity_type string, entity_id string, timestamp timestamp_ntz, "
    "tipo_evento string, valor string"
)

FORECAST = (
    "codigo_ine string, fecha_prevision date, fecha_consulta timestamp_ntz, "
    "tmax decimal(4,1), tmin decimal(4,1), precipitacion_mm decimal(5,1), lluvia_mm decimal(5,1), "
    "prob_precipitacion smallint, viento_velocidad decimal(5,1), viento_direccion smallint, "
    "racha_max decimal(5,1), uv_max decimal(4,2), et0_evapotranspiracion decimal(5,2), "
    "radiacion_solar decimal(6,2), weather_code smallint, humedad_max decimal(4,1), "
    "humedad_min decimal(4,1), estado_cielo_cod string, estado_cielo_desc string, datos_raw string"
)

MUNICIPALITIES = (
    "codigo_ine string, nombre string, provincia string, "
    "lat decimal(9,6), lon decimal(9,6), activo boolean"
)

PARCELS = (
    "id int, usuario_id int, parcela_id string, provincia int, municipio int, poligono int, "
    "parcela int, recinto int, nombre string, cultivo string, variedad string, edad_cultivo string, "
    "superficie decimal(10,4), lat decimal(10,6), lng decimal(10,6), geometria string, "
    "zonas array<struct<id:string,lat:double,lng:double,cultivo:string,emoji:string>>, "
    "grid string, fecha_registro timestamp_ntz"
)

GREENHOUSES = (
    "id int, usuario_id int, nombre string, temperatura_entity_id string, "
    "hum_amb_entity_id string, created_at timestamp_ntz"
)

PLANTS = (
    "id int, invernadero_id int, tipo string, variedad string, grid_col int, grid_row int, "
    "soil_entity_id string, created_at timestamp_ntz"
)

CONNECTIONS = (
    "id int, user_id int, ha_url string, ha_token string, display_name string, "
    "created_at timestamp_ntz, last_seen_at timestamp_ntz"
)

SENSORS = (
    "sensor_id string, connection_id int, user_id int, location_id int, location_type string, "
    "sensor_type string, display_name string, active boolean, created_at timestamp_ntz"
)

DEVICE_STATES = (
    "entity_id string, state string, "
    "attributes struct<device_class:string,friendly_name:string,unit_of_measurement:string>"
)

CHUNKS = (
    "chunk_id string, doc_path string, cultivo string, tipo_doc string, titulo string, "
    "texto string, embedding array<double>, created_at timestamp_ntz"
)

ALERTS = (
    "alerta string, activa boolean, nivel string, id_victima string, id_agresor string, "
    "distancia_metros double, direccion_escape string, coordenadas_agresor string, "
    "coordenadas_victima string, coordenadas_place string, timestamp string, "
    "dist_seguridad double, distancia_limite double, id_place string, nombre_place string, "
    "radio_zona double"
)

CROP_REFERENCE = (
    "map<string,struct<nombre:string,nombre_cientifico:string,tipo:string,kc_inicio:double,"
    "kc_desarrollo:double,kc_medio:double,kc_final:double,profundidad_raiz_m:double,"
    "tolerancia_sequia:string,riego_tipico:string,ciclo_dias:int,variedades:array<string>,"
    "notas:string>>"
)

DAILY_SERIES = (
    "parcela_id string, cultivo string, lat double, lon double, fecha date, "
    "temp_max_c double, temp_min_c double, temp_media_c double, precipitacion_mm double, "
    "lluvia_mm double, humedad_rel_pct double, viento_max_kmh double, viento_medio_kmh double, "
    "radiacion_solar_mjm2 double, et0_mm double, fuente string, humedad_suelo_m3m3 double, "
    "temp_suelo_c double, kc_aplicado double, etc_mm double, deficit_hidrico_mm double"
)
