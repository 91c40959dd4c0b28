"""Schemas of the feed and of every target; parse and write share these.

Fixed values: the field names, their order and their types are the data model
that sources and targets agree on.
"""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, DBL, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampType(),
)
POINT = T.StructType([T.StructField("lon", DBL), T.StructField("lat", DBL)])


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The 15 fields of one feed line. Longitude and latitude stay text here because
# well-known text is built from the tokens as they came.
FEED_FIELDS = [
    ("planeid", STR),
    ("ts", LONG),
    ("speed", DBL),
    ("dist", DBL),
    ("bearing", DBL),
    ("rtid", INT),
    ("orig", STR),
    ("dest", STR),
    ("secstodep", INT),
    ("lon_token", STR),
    ("lat_token", STR),
    ("geohash", STR),
    ("sqrhash", STR),
    ("pntytrihash", STR),
    ("flattrihash", STR),
]
N_BASE = 11  # fields every shape needs
N_FULL = 15  # fields the shapes with hash values need

_MOTION = [("speed", DBL), ("dist", DBL), ("bearing", DBL), ("rtid", INT)]
_ROUTE = [("orig", STR), ("dest", STR), ("secstodep", INT)]
_LON_LAT = [("lon", DBL), ("lat", DBL)]
_HASHES = [("geohash", STR), ("sqrhash", STR), ("pntytrihash", STR), ("flattrihash", STR)]


def planes12(id_type: T.DataType = LONG) -> T.StructType:
    return _schema(
        ("id", id_type), ("ts", TS), *_MOTION, *_ROUTE, *_LON_LAT, ("geometry", STR)
    )


PLANES16 = _schema(
    ("id", STR), ("ts", TS), *_MOTION, *_ROUTE, *_LON_LAT, ("geometry", STR), *_HASHES
)

PLANES18 = _schema(
    ("globalid", STR),
    ("objectid", LONG),
    ("plane_id", STR),
    ("ts", TS),
    *_MOTION,
    *_ROUTE,
    *_LON_LAT,
    ("geometry", POINT),
    ("esri_geohash_geohash_4326_12", STR),
    ("esri_geohash_square_102100_30", STR),
    ("esri_geohash_pointytriangle_102100_30", STR),
    ("esri_geohash_flattriangle_102100_30", STR),
)

# Bulk-copy targets. The serial objectid is assigned by the database, and the
# nullable geo_hash column of the second one is never filled, so neither is sent.
COPY16 = _schema(
    ("id", STR), ("ts", STR), *_MOTION, *_ROUTE, *_LON_LAT, *_HASHES, ("geometry", STR)
)
COPY16_GLOBAL = _schema(
    ("globalid", STR),
    ("ts", STR),
    *_MOTION,
    *_ROUTE,
    ("longitude", DBL),
    ("latitude", DBL),
    ("esri_geohash_geohash_4326_12", STR),
    ("esri_geohash_square_102100_26", STR),
    ("esri_geohash_pointytriangle_102100_26", STR),
    ("esri_geohash_flattriangle_102100_26", STR),
    ("geometry", STR),
)

MESSAGE = _schema(("key", STR), ("value", STR))

# Document field names by the column they are filled from.
DOCUMENT_FIELDS = {
    "objectid": "objectid",
    "globalid": "globalid",
    "planeid": "planeid",
    "ts": "ts",
    "speed": "speed",
    "dist": "dist",
    "bearing": "bearing",
    "rtid": "rtid",
    "orig": "orig",
    "dest": "dest",
    "secsToDep": "secstodep",
    "longitude": "longitude",
    "latitude": "latitude",
}
DOCUMENT_HASH_FIELDS = {"square": "sqrhash", "pointy": "pntytrihash", "flat": "flattrihash"}
DOCUMENT_AGG_FIELD = "---geo_hash---"


def document(extra_hashes: bool = False, agg_field: bool = False) -> T.StructType:
    """Schema of one document, for reading it back."""
    point = T.ArrayType(DBL)
    fields = [
        ("objectid", LONG),
        ("globalid", STR),
        ("planeid", STR),
        ("ts", LONG),
        *_MOTION,
        ("orig", STR),
        ("dest", STR),
        ("secsToDep", INT),
        ("longitude", DBL),
        ("latitude", DBL),
    ]
    if extra_hashes:
        fields += [(n, STR) for n in DOCUMENT_HASH_FIELDS]
    if agg_field:
        fields.append((DOCUMENT_AGG_FIELD, point))
    return _schema(*fields, ("geometry", point))
