"""Column lists of the feeds. Everything arrives as text; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

# Header names after normalisation, in file order.
LIQUID_FIELDS = (
    "ID3", "ACTIVIDAD", "REGISTRO_DE_HIDROCARBUROS", "RUC", "RAZON_SOCIAL", "DEPARTAMENTO", "PROVINCIA", "DISTRITO",
    "DIRECCION", "FECHA_DE_REGISTRO", "PRODUCTO", "PRECIO_DE_VENTA_SOLES", "UNIDAD",
)
LPG_FIELDS = (
    "ID4", "ACTIVIDAD", "REGISTRO_DE_HIDROCARBUROS", "RUC", "RAZON_SOCIAL", "DEPARTAMENTO", "PROVINCIA", "DISTRITO",
    "DIRECCION", "FECHA_DE_REGISTRO", "PRODUCTO", "TIPO_DE_CLIENTE", "MARCA", "PRECIO_DE_VENTA_SOLES", "UNIDAD",
)
REGISTRY_FIELDS = (
    "SOURCE_ACTIVITY", "REGISTRO", "CODIGO_OSINERGMIN", "CODIGO", "DEPARTAMENTO", "PROVINCIA", "DISTRITO",
    "ACTIVIDAD",
)
POINT_FIELDS = (
    "LAYER", "OBJECTID", "N", "COD_OSINERGMIN", "CODIGO_DGH", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "LONGITUDE",
    "LATITUDE",
)
PRIVATE_FIELDS = ("RUC", "RAZON_SOCIAL", "DIRECCION", "MARCA")


@dataclass(frozen=True)
class Feed:
    """A delimited feed: its columns, and the one that identifies a report."""

    name: str
    fields: tuple[str, ...]
    id_field: str

    @property
    def minimised(self) -> list[str]:
        return [f for f in self.fields if f not in PRIVATE_FIELDS]


LIQUID = Feed("liquid-current", tuple(LIQUID_FIELDS), "ID3")
LPG = Feed("glp-current", tuple(LPG_FIELDS), "ID4")
REGISTRY = Feed("registry", tuple(REGISTRY_FIELDS), "REGISTRO")
POINTS = Feed("points", tuple(POINT_FIELDS), "OBJECTID")
