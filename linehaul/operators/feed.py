"""Position feed lines to typed rows, rejects, and the row shapes of each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linehaul import schemas as S
from linehaul.functions.geo import ewkt_point, geo_array, point_struct, wkt_point
from linehaul.functions.ids import with_uuid
from linehaul.functions.times import format_epoch_ms

_CORRUPT = "_corrupt"
_RECORD = "_record"
_CSV_OPTIONS = {
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "positiveInf": "Infinity",
    "negativeInf": "-Infinity",
    "columnNameOfCorruptRecord": _CORRUPT,
}
_CSV = f"map({', '.join(repr(x) for kv in _CSV_OPTIONS.items() for x in kv)})"
# One field as the CSV parser takes it: a quoted part with text after it, or an open quote
# to the end, or text in which quotes are plain; a line end closes all but quoted parts.
_FIELD = r"""(?:"[^"]*+(?:""[^"]*+)*+"[^,\\r\\n]*+|"(?s:.*+)|[^,\\r\\n]*+)"""
# Numeric fields in the order in which a bad one is reported.
_NUMERIC = ["ts", "speed", "dist", "bearing", "rtid", "secstodep", "longitude", "latitude"]
_HASHES = [n for n, _ in S.FEED_FIELDS[S.N_BASE :]]
_PARSED = [*[n for n, _ in S.FEED_FIELDS], "longitude", "latitude", "reject_reason"]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _first_record(line: str) -> str:
    """SQL for the fields in use, and one more to keep the record marked, of the CSV record a
    text starts with. The same cut is made in every line, so that neither the length of a
    line nor the number of its fields reaches the parser's limits."""
    return f"regexp_extract({line}, '^(?:{_FIELD},){{0,{S.N_FULL}}}+{_FIELD}', 0)"


def _as_double(token: str) -> str:
    """SQL casting a token to a number, with Java's spellings of the special ones only."""
    special = f"contains({token}, 'n') OR contains({token}, 'N')"
    known = f"trim({token}) RLIKE '^[+-]?(NaN|Infinity)$'"
    return f"if(({special}) AND NOT {known}, NULL, try_cast({token} AS double))"


def _fewer_than(n: int) -> str:
    """SQL telling whether the record has fewer than n fields.

    The CSV parser gives null for an empty field and for a missing one; it
    marks the record when the count is not 15. Only a marked record whose n-th
    field is null needs its fields counted, commas inside quotes left out.
    """
    nth = S.FEED_FIELDS[n - 1][0]
    count = f"""size(split(regexp_replace({_RECORD}, '"[^"]*"', ''), ','))"""
    return f"""CASE WHEN {_RECORD} IS NULL OR {_RECORD} = '' THEN true
        WHEN {_CORRUPT} IS NOT NULL AND {nth} IS NULL THEN {count} < {n}
        ELSE false END"""


def parse_feed(
    df: DataFrame,
    line: str = "line",
    hashes: bool = False,
    id_type: str = "string",
    mode: str = "rejects",
) -> DataFrame:
    """Parse ``line`` into the typed feed columns, keeping all other columns.

    A line is bad when it has too few fields (11, or 15 with ``hashes``) or a
    number that does not parse; more fields than 15 are ignored. Bad lines stay
    in the result with ``reject_reason`` set, see :func:`good_rows` and
    :func:`rejected_rows`; with ``mode='failfast'`` the first one fails the job.
    ``id_type='bigint'`` asks for a numeric plane id.
    """
    if id_type not in ("string", "bigint"):
        raise ValueError("id_type must be 'string' or 'bigint'")
    if mode not in ("rejects", "failfast"):
        raise ValueError("mode must be 'rejects' or 'failfast'")
    kept = [_quoted(c) for c in df.columns if c != line]
    taken = ({*df.columns} - {line}) & {*_PARSED, _CORRUPT, _RECORD}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of the feed; rename them first")
    line = _quoted(line)
    types = {n: t.simpleString() for n, t in S.FEED_FIELDS} | {"planeid": id_type}
    schema = ", ".join(f"{n} {t}" for n, t in types.items()) + f", {_CORRUPT} string"

    # A generator keeps the parse in one place: filters and projections on its
    # output are not merged into it, so each line is parsed exactly once.
    parse = f"inline(array(from_csv({_RECORD}, '{schema}', {_CSV})))"
    records = df.selectExpr(*kept, line, f"{_first_record(line)} AS {_RECORD}")
    fields = records.selectExpr(*kept, line, _RECORD, parse)

    # An empty text field is an empty text, not a missing one; where hash fields
    # are optional, one is missing when the line ends before it.
    column = {n: n for n in types}
    for n in ["orig", "dest", *_HASHES] + (["planeid"] if id_type == "string" else []):
        column[n] = f"coalesce({n}, '')"
    if not hashes:
        for i, n in enumerate(_HASHES, start=S.N_BASE + 1):
            column[n] = f"coalesce({n}, CASE WHEN NOT {_fewer_than(i)} THEN '' END)"
    column["longitude"] = _as_double("lon_token")
    column["latitude"] = _as_double("lat_token")

    short = _fewer_than(S.N_FULL if hashes else S.N_BASE)
    numeric = (["planeid"] if id_type == "bigint" else []) + _NUMERIC
    reasons = [f"WHEN {short} THEN 'too_few_fields'"]
    reasons += [f"WHEN {n} IS NULL THEN 'bad_{n}'" for n in numeric]
    reason = f"CASE {' '.join(reasons)} END"
    if mode == "failfast":
        reason = f"if({reason} IS NULL, NULL, raise_error(concat_ws(': ', {reason}, {line})))"
    column["reject_reason"] = f"cast({reason} AS string)"
    return fields.selectExpr(*kept, line, *[f"{sql} AS {n}" for n, sql in column.items()])


def good_rows(parsed: DataFrame, line: str = "line") -> DataFrame:
    """The typed rows, without the line they came from."""
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", line)


def rejected_rows(parsed: DataFrame, line: str = "line") -> DataFrame:
    """Rejected lines with their reason and the columns that came with them."""
    feed = set(_PARSED) - {"reject_reason"}
    return parsed.filter(F.col("reject_reason").isNotNull()).drop(*feed)


def _instant(ts_mode: str) -> Column:
    if ts_mode == "event":
        return F.timestamp_millis("ts")
    if ts_mode == "ingest":
        return F.current_timestamp()
    raise ValueError("ts_mode must be 'event' or 'ingest'")


def _moved(schema, **filled: Column | str) -> list[Column]:
    """The columns of a schema by name, some of them filled from elsewhere."""
    out = []
    for f in schema:
        source = filled.get(f.name, f.name)
        column = F.col(source) if isinstance(source, str) else source
        out.append(column.cast(f.dataType).alias(f.name))
    return out


def to_planes12(good: DataFrame, id_from: str = "feed", ts_mode: str = "event") -> DataFrame:
    """Rows of the 12-column table.

    ``id_from='feed'`` takes the plane id (a number), ``'uuid'`` draws a random
    text id; ``ts_mode='ingest'`` stamps rows with the time of the query or
    micro-batch in place of the time in the line.
    """
    filled = {
        "ts": _instant(ts_mode),
        "lon": "longitude",
        "lat": "latitude",
        "geometry": wkt_point("lon_token", "lat_token"),
    }
    if id_from == "feed":
        return good.select(*_moved(S.planes12(S.LONG), id="planeid", **filled))
    if id_from == "uuid":
        return with_uuid(good, "id").select(*_moved(S.planes12(S.STR), **filled))
    raise ValueError("id_from must be 'feed' or 'uuid'")


def to_planes16(good: DataFrame) -> DataFrame:
    """Rows of the table that keeps the four hash fields, under a random id."""
    return with_uuid(good, "id").select(
        *_moved(
            S.PLANES16,
            ts=_instant("event"),
            lon="longitude",
            lat="latitude",
            geometry=wkt_point("lon_token", "lat_token"),
        )
    )


def to_planes18(good: DataFrame) -> DataFrame:
    """Rows of the table with global and object ids; ``objectid`` must be there already."""
    with_id = good if "globalid" in good.columns else with_uuid(good, "globalid")
    return with_id.select(
        *_moved(
            S.PLANES18,
            plane_id="planeid",
            ts=_instant("event"),
            lon="longitude",
            lat="latitude",
            geometry=point_struct("longitude", "latitude"),
            esri_geohash_geohash_4326_12="geohash",
            esri_geohash_square_102100_30="sqrhash",
            esri_geohash_pointytriangle_102100_30="pntytrihash",
            esri_geohash_flattriangle_102100_30="flattrihash",
        )
    )


def to_copy_rows(good: DataFrame, with_globalid: bool = False) -> DataFrame:
    """Columns of a bulk copy, in copy order: formatted time, extended well-known text.

    ``with_globalid`` selects the target whose id, position and hash columns
    carry the longer names.
    """
    shared = {
        "ts": format_epoch_ms("ts"),
        "geometry": ewkt_point("lon_token", "lat_token"),
    }
    if with_globalid:
        with_id = good if "globalid" in good.columns else with_uuid(good, "globalid")
        return with_id.select(
            *_moved(
                S.COPY16_GLOBAL,
                esri_geohash_geohash_4326_12="geohash",
                esri_geohash_square_102100_26="sqrhash",
                esri_geohash_pointytriangle_102100_26="pntytrihash",
                esri_geohash_flattriangle_102100_26="flattrihash",
                **shared,
            )
        )
    with_id = good if "id" in good.columns else with_uuid(good, "id")
    return with_id.select(*_moved(S.COPY16, lon="longitude", lat="latitude", **shared))


def copy_line(rows: DataFrame, name: str = "copy_line") -> DataFrame:
    """One CSV text per copy row: text quoted (the id apart), quotes doubled, null as ``null``."""
    id_name = rows.columns[0]
    parts = []
    for f in rows.schema:
        c = F.col(f.name).cast("string")
        if f.dataType == S.STR and f.name != id_name:
            c = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        parts.append(F.coalesce(c, F.lit("null")))
    return rows.select(F.concat_ws(",", *parts).alias(name))


def document_struct(extra_hashes: bool = True, agg_field: bool = False) -> Column:
    """One document as a struct, from good rows that carry ``objectid`` and ``globalid``."""
    fields = dict(S.DOCUMENT_FIELDS)
    if extra_hashes:
        fields |= S.DOCUMENT_HASH_FIELDS
    columns = [F.col(source).alias(name) for name, source in fields.items()]
    point = geo_array("longitude", "latitude")
    if agg_field:
        columns.append(point.alias(S.DOCUMENT_AGG_FIELD))
    return F.struct(*columns, point.alias("geometry"))


def to_documents(
    good: DataFrame, extra_hashes: bool = True, agg_field: bool = False, as_text: bool = True
) -> DataFrame:
    """Documents as JSON text in ``document``, or as columns with ``as_text=False``.

    ``objectid`` must be there already; ``globalid`` is drawn when missing.
    """
    with_id = good if "globalid" in good.columns else with_uuid(good, "globalid")
    doc = document_struct(extra_hashes, agg_field)
    if as_text:
        return with_id.select(F.to_json(doc).alias("document"))
    return with_id.select(F.inline(F.array(doc)))


# Strict JSON, without the parser's own limits on numbers and texts. It copies values nested
# up to 1000 deep; a line that is refused and opens more levels gets a reason of its own.
MAX_NESTING = 1000
_JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxNumLen": str(2**31 - 1),
    "maxStringLen": str(2**31 - 1),
}


def is_json_document(value: str | Column) -> Column:
    """True where the text is exactly one JSON value, nested ``MAX_NESTING`` deep at most.

    The parser stops at the end of the first value. In an array that also holds
    a hash of the text, anything after that value either breaks the array or
    moves the hash from second place.
    """
    value = F.col(value) if isinstance(value, str) else value
    mark = F.xxhash64(value).cast("string")
    pair = F.concat(F.lit("["), value, F.lit(","), mark, F.lit("]"))
    both = F.from_json(pair, "array<string>", _JSON_OPTIONS)
    return F.coalesce((F.size(both) == 2) & (F.get(both, F.lit(1)) == mark), F.lit(False))


def json_reject_reason(value: str | Column) -> Column:
    """Why a line is no document for a target, else null: ``not_json``, ``too_deep_or_not_json``
    (more than ``MAX_NESTING`` opening brackets), ``not_an_object``."""
    value = F.col(value) if isinstance(value, str) else value
    opened = F.char_length(value) - F.char_length(F.translate(value, "[{", ""))
    broken = ~is_json_document(value)
    return (
        F.when(broken & (opened > MAX_NESTING), F.lit("too_deep_or_not_json"))
        .when(broken, F.lit("not_json"))
        .when(~F.ltrim(F.translate(value, "\t\r\n", "   ")).startswith("{"), F.lit("not_an_object"))
        .otherwise(F.lit(None).cast("string"))
    )


def documents_from_json(df: DataFrame, schema: StructType, value: str = "line") -> DataFrame:
    """JSON lines as columns, for a document target that takes rows, and the whole text.

    The schema is given: working it out would be a pass of its own over all lines. What it
    does not name stays in ``document``, the text as it came. Lines that are no JSON object
    are left out; :func:`rejected_documents` has them.
    """
    valid = df.filter(json_reject_reason(value).isNull())
    known = F.from_json(F.col(value), schema, _JSON_OPTIONS)
    return valid.select(F.inline(F.array(known)), F.col(value).alias("document"))


def rejected_documents(df: DataFrame, value: str = "line") -> DataFrame:
    """The lines that are no JSON object, with their ``reject_reason``."""
    return df.withColumn("reject_reason", json_reject_reason(value)).filter("reject_reason is not null")


def json_lines(df: DataFrame, value: str = "line") -> DataFrame:
    """Pass lines through untouched, with ``valid`` telling documents from broken lines."""
    return df.withColumn("valid", is_json_document(value))
