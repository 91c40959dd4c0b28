"""Point geometries, one form per kind of target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SRID_PREFIX = "SRID=4326;"


def wkt_point(lon_token: str | Column, lat_token: str | Column) -> Column:
    """``POINT (lon lat)`` from the tokens as read, so trailing zeros survive."""
    lon, lat = (F.col(c) if isinstance(c, str) else c for c in (lon_token, lat_token))
    return F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")"))


def ewkt_point(lon_token: str | Column, lat_token: str | Column) -> Column:
    """The same with the spatial reference in front."""
    return F.concat(F.lit(SRID_PREFIX), wkt_point(lon_token, lat_token))


def geo_array(lon: str | Column, lat: str | Column) -> Column:
    """``[lon, lat]`` from parsed numbers."""
    return F.array(lon, lat)


def point_struct(lon: str | Column, lat: str | Column) -> Column:
    """A typed point; the writer of a target with its own point type converts it."""
    lon, lat = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    return F.struct(lon.alias("lon"), lat.alias("lat"))
