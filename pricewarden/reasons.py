"""Codes that travel in results. Consumers compare them as text."""

# Rows left out before the funnel starts.
OTHER_UNIT = "otra_unidad"
OTHER_CLIENT = "otro_tipo_de_cliente"

# Where a latest report ends. Order matters: the first that applies is the reason.
INVALID_REPORT = "reporte_invalido"
CONFLICT = "conflicto_precio_o_territorio"
EXPIRED_REPORT = "reporte_vencido"
NO_REGISTRY = "no_cruza_registro"
NO_UNIQUE_POINT = "sin_gis_unico"
REPEATED_ID = "id_repetido_en_el_raw"
NO_IDENTITY = "sin_razon_social_o_direccion"
PUBLISHED = "publicada"
PUBLISHED_EXPIRED = "publicada_sin_precio_vigente"
NEVER_REPORTED = "sin_reporte_en_lima"

# Why a price was or was not chosen.
CSV_AFTER_LIVE = "csv_posterior_a_la_consulta"
LIVE_CURRENT = "consulta_vigente"
CSV_CURRENT = "reporte_vigente"
CSV_FUTURE = "reporte_futuro"
CSV_EXPIRED = "reporte_vencido"
NO_PRICE = "sin_precio_utilizable"

# Why a captured unit was rejected as a whole.
WRONG_PRODUCT = "producto_no_coincide"
UNKNOWN_HEADERS = "cabeceras_desconocidas"
BAD_WIDTH = "fila_con_forma_inesperada"
WRONG_DISTRICT = "distrito_no_coincide"
WRONG_UNIT = "unidad_no_coincide"
BAD_PRICE = "precio_ilegible"
INCOMPLETE = "extraccion_incompleta"
WRONG_TOTAL = "total_no_coincide"
NO_ANSWER = "sin_respuesta"
ATTEMPT_OK = "ok"
ATTEMPT_STALE = "descartada_por_anterior"

# Why a directory entry was not accredited.
NO_CANDIDATE = "sin_candidato"
OTHER_DISTRICT = "distrito_contradictorio"
NO_EVIDENCE = "sin_corroboracion"
THIN_MARGIN = "margen_insuficiente"
DIRECTORY_CONFLICT = "conflicto_entre_directorios"
OPERATOR_CLASH = "choque_con_operador"
LOST_ASSIGNMENT = "perdio_asignacion"

# Sampling strata of a directory entry.
STRATUM_DISTRICT = "distrito_declarado"
STRATUM_PRECISE = "sin_distrito_coordenada_precisa"
STRATUM_APPROXIMATE = "sin_distrito_coordenada_aproximada"
STRATUM_USELESS = "sin_distrito_coordenada_inutil"
