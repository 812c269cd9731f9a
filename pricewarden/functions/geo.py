"""Distances, boxes and the grid that turns a distance predicate into an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_M = 6371008.8
EARTH_M_ROUND = 6371000.0
METRES_PER_DEGREE = 111195.0
# The box a published coordinate has to fall into.
LON_MIN, LON_MAX, LAT_MIN, LAT_MAX = -82.0, -68.0, -19.0, 1.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(chord))


def is_coordinate(lat: Column, lon: Column) -> Column:
    """Finite and on the globe; between() already rejects NaN and the infinities."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def checked_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A distance that fails the job on an unusable coordinate instead of dropping the row."""
    usable = is_coordinate(lat1, lon1) & is_coordinate(lat2, lon2)
    return F.when(usable, haversine(lat1, lon1, lat2, lon2)).otherwise(
        F.raise_error(F.lit("coordinate out of range")).cast("double")
    )


def in_published_box(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(LON_MIN, LON_MAX) & lat.between(LAT_MIN, LAT_MAX), F.lit(False))


def box_around(lat: Column, lon: Column, origin_lat: float, origin_lon: float, km: float) -> Column:
    """Cheap necessary condition for `distance <= km`; pushes to the scan as plain comparisons."""
    dlat = math.degrees(km / EARTH_KM) * 1.0001 + 1e-9
    edge = min(abs(origin_lat) + dlat, 90.0)
    test = lat.between(origin_lat - dlat, origin_lat + dlat)
    reach = math.sin(min(km / EARTH_KM, math.pi / 2)) / max(math.cos(math.radians(edge)), 1e-12)
    if reach >= 1.0:
        return test
    dlon = math.degrees(math.asin(reach)) * 1.0001 + 1e-9
    if origin_lon - dlon < -180.0 or origin_lon + dlon > 180.0:
        return test
    return test & lon.between(origin_lon - dlon, origin_lon + dlon)


# --- grid ---------------------------------------------------------------------------------------
# Bands of equal height; inside a band a whole number of cells, none narrower than the band is high
# (measured at the band's edge nearest the pole). A cell id is band and cell packed into one long.


def _cells_in_band(band: Column, height: Column) -> Column:
    edge = F.least(F.greatest(F.abs(band * height), F.abs((band + 1) * height)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("long")


def _pack(band: Column, cell: Column) -> Column:
    return F.shiftleft(band.cast("long") + F.lit(1 << 24), 32) + cell.cast("long")


def grid_cell(lat: Column, lon: Column, height_deg: Column | float) -> Column:
    height = F.lit(height_deg) if isinstance(height_deg, float) else height_deg
    count = _cells_in_band(F.floor(lat / height), height)
    cell = F.floor((lon + 180.0) / 360.0 * count)
    return _pack(F.floor(lat / height), F.pmod(cell, count))


def grid_probe(
    lat: Column, lon: Column, half_lat_deg: Column, half_lon_deg: Column, height_deg: Column | float
) -> Column:
    """Ids of every cell that the box around a point touches, each once.

    The box is computed once per row and named, so the nested loops over bands and cells only refer to it.
    """
    height = F.lit(height_deg) if isinstance(height_deg, float) else height_deg
    box = F.struct(
        height.alias("height"),
        F.floor((lat - half_lat_deg) / height).alias("low"),
        F.floor((lat + half_lat_deg) / height).alias("high"),
        ((lon - half_lon_deg + 180.0) / 360.0).alias("west"),
        ((lon + half_lon_deg + 180.0) / 360.0).alias("east"),
    )

    def cells(b: Column) -> Column:
        bands = F.transform(
            F.sequence(b["low"], b["high"]),
            lambda band: F.struct(band.alias("band"), _cells_in_band(band, b["height"]).alias("count")),
        )
        return F.flatten(
            F.transform(
                bands,
                lambda n: F.transform(
                    F.sequence(
                        F.floor(b["west"] * n["count"]),
                        F.least(F.floor(b["east"] * n["count"]), F.floor(b["west"] * n["count"]) + n["count"] - 1),
                    ),
                    lambda cell: _pack(n["band"], F.pmod(cell, n["count"])),
                ),
            )
        )

    return F.array_distinct(F.get(F.transform(F.array(box), cells), F.lit(0)))


def grid_height(metres: float) -> float:
    return metres / METRES_PER_DEGREE * 1.001


def circle_probe(lat: Column, lon: Column, metres: float) -> Column:
    """Cells a circle can touch; the margin keeps points exactly on the radius."""
    half = grid_height(metres)
    far = F.least(F.abs(lat) + half, F.lit(89.999))
    half_lon = F.least(F.lit(180.0), F.lit(half * 1.001) / F.cos(F.radians(far)))
    return grid_probe(lat, lon, F.lit(half), half_lon, half)
