"""Mixed timestamp spellings to UTC instants (problem 7).

Distinct spellings, with their source, zone and date order, form a dictionary that is parsed once and joined back to the
rows. The dictionary is a table in the shared folder that outlives the query and the driver: each run adds what it lacks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast

from ..session import exists, materialize, shared_dir

UNDATED, RESOLVED, UNRESOLVED = "undated", "resolved", "unresolved"

# Zone abbreviations in their European and North American meaning, minutes east of UTC.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_ZONE = r"\s*(?P<z>[A-Za-z]{1,5}|[+-]\d{2}:?\d{2}|[+-]\d{1,2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)?"
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)")
_ISO = re.compile(r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})(?:[Tt]|\s+)" + _TIME + _ZONE)
_BASIC = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt ](?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE)
_MAIL = re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[ -](?P<mon>[A-Za-z]{3,9})[ -](?P<y>\d{4})\s+" + _TIME + _ZONE)
_SLASH = re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4})(?:[Tt]|,?\s+)" + _TIME + r"\s*(?P<ap>[AaPp]\.?[Mm]\.?)?" + _ZONE)
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    if not name:
        return None
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=4096)
def _offset_minutes(text: str) -> int | None:
    """Minutes east of UTC of a written zone or offset; None if it is no known one."""
    up = text.upper()
    if up in ZONE_MINUTES:
        return ZONE_MINUTES[up]
    if up[:3] in ("UTC", "GMT") and len(up) > 3:
        up = up[3:]
    if m := re.fullmatch(r"([+-])(\d{1,2}):?(\d{2})?", up):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if minutes < 60 and hours * 60 + minutes <= 18 * 60:
            return (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)
    return None


def read_stamp(raw: str | None, zone: str | None, order: str | None) -> tuple[str, int | None, str | None]:
    """(status, microseconds since 1970 UTC, digits beyond) of one spelling written on a host of that zone and date order.

    Null, blank and numbers <= 0 are undated. Other plain numbers are epoch time. A stamp that isn't one
    single instant (unreadable, impossible, zone unknown, local time skipped or repeated, several readings)
    is unresolved. Instants keep the written precision: what follows the microseconds is given as digits, without zeros at
    their end, '' if there are none.
    """
    nothing = (UNRESOLVED, None, None)
    if raw is None or not (text := raw.strip()):
        return UNDATED, None, None
    if _NUMBER.fullmatch(text):
        value = Decimal(text)
        if value <= 0:
            return UNDATED, None, None
        shift = 0 if value > 10**14 else 3 if value > 10**11 else 6
        whole, _, part = text.lstrip("+").partition(".")
        part = part.ljust(shift, "0")
        whole = (whole + part[:shift]).lstrip("0")
        if len(whole) > 18 or int(whole or 0) >= 2**62:
            return nothing
        return RESOLVED, int(whole or 0), part[shift:].rstrip("0")
    if m := _ISO.fullmatch(text) or _BASIC.fullmatch(text):
        g = m.groupdict()
        dates = {(int(g["mo"]), int(g["d"]))}
    elif m := _MAIL.fullmatch(text):
        g = m.groupdict()
        dates = {(MONTHS.get(g["mon"][:3].lower(), 0), int(g["d"]))}
    elif m := _SLASH.fullmatch(text):
        g = m.groupdict()
        a, b = int(g["a"]), int(g["b"])
        dates = {(a, b)} if order == "mdy" else {(b, a)} if order == "dmy" else {(a, b), (b, a)}
    else:
        return nothing
    hour = int(g["h"])
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return nothing
        hour = hour % 12 + (12 if half[0] in "Pp" else 0)
    fraction = g["f"] or ""
    micro, rest = int(fraction[:6].ljust(6, "0")), fraction[6:].rstrip("0")
    readings = set()
    for month, day in dates:
        try:
            readings.add(datetime(int(g["y"]), month, day, hour, int(g["mi"]), int(g["s"] or 0), micro))
        except ValueError:
            pass
    if len(readings) != 1:
        return nothing
    local = readings.pop()
    if g["z"]:
        minutes = _offset_minutes(g["z"])
        if minutes is None:
            return nothing
        return RESOLVED, (local - _EPOCH) // _MICRO - minutes * 60_000_000, rest
    if (tz := _zone(zone)) is None:
        return nothing
    try:
        early = local.replace(tzinfo=tz).utcoffset()
        if early != local.replace(tzinfo=tz, fold=1).utcoffset():
            return nothing
    except OverflowError:
        return nothing
    return RESOLVED, (local - _EPOCH - early) // _MICRO, rest


_KEYS = ["_raw", "_source", "_zone", "_order"]
_WORDS = T.StructType([*(T.StructField(k, T.StringType()) for k in _KEYS), T.StructField("status", T.StringType()), T.StructField("micros", T.LongType()), T.StructField("rest", T.StringType())])
#: Spellings read by other rules aren't taken over: to be raised with any change of read_stamp().
RULES = 1
#: A spelling that makes up more than one row in so many is joined by broadcast; there can't be more such spellings.
HOT_PARTS = 1024


def clocks(host_clock: DataFrame) -> DataFrame:
    """One row of (_host, _zone, _order) for each host; what a host's rows contradict each other in is unknown."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c))
    known = host_clock.where(F.col("host_id").isNotNull())
    return known.groupBy(F.col("host_id").alias("_host")).agg(one("zone_name").alias("_zone"), one("date_order").alias("_order"))


def with_clock(rows: DataFrame, host_clock: DataFrame) -> DataFrame:
    """rows (with _raw, _host) and the zone and date order of their host, '' where unknown. Hosts are a dimension."""
    joined = rows.join(clocks(host_clock), "_host", "left")
    return joined.withColumns({"_zone": F.coalesce("_zone", F.lit("")), "_order": F.coalesce("_order", F.lit(""))})


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary is kept: one folder for all runs that share spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/spanledger-stamps-{RULES}"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """The dictionary as it stands, one row a key; None if there is none yet.

    Two runs at once may both have added a key. They read it alike, and the aggregation below has the partitioning that the
    joins on the keys need.
    """
    if not exists(spark, path):
        return None
    held = spark.read.schema(_WORDS).option("recursiveFileLookup", "true").parquet(path)
    return held.groupBy(*_KEYS).agg(F.min("status").alias("status"), F.min("micros").alias("micros"), F.min("rest").alias("rest"))


def build_dictionary(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The distinct spellings of rows (with _KEYS), read: keys, n (rows that have it now), status, micros, rest, fresh.

    With path, a kept dictionary: what it knows isn't read again, and what it lacks is added to it, in a folder of its own that
    appears there when it is whole. Null spellings are kept as one of their own.
    """
    spark = rows.sparkSession
    seen = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    known = read_dictionary(spark, path) if path else None
    if known is None:
        asked = seen.select("*", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("micros"), F.lit(None).cast("string").alias("rest"))
    else:
        named = known.withColumnsRenamed({k: f"known{k}" for k in _KEYS})
        asked = seen.join(named, [F.col(k).eqNullSafe(F.col(f"known{k}")) for k in _KEYS], "left").select(*seen.columns, "status", "micros", "rest")
    schema = T.StructType([*asked.schema.fields, T.StructField("fresh", T.BooleanType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = lambda c: [x if isinstance(x, str) else None for x in pdf[c].tolist()]
            status, micros, rest = none("status"), [None if x is None or x != x else int(x) for x in pdf["micros"].astype(object).tolist()], none("rest")
            fresh = [s is None for s in status]
            for i, (lacking, raw, zone, order) in enumerate(zip(fresh, none("_raw"), none("_zone"), none("_order"))):
                if lacking:
                    status[i], micros[i], rest[i] = read_stamp(raw, zone, order)
            yield pdf.assign(status=status, micros=pd.array(micros, dtype="Int64"), rest=rest, fresh=fresh)

    # A long must not pass through a double on its way into pandas: null micros go as text.
    words = materialize(asked.withColumn("micros", F.col("micros").cast("string")).mapInPandas(read, schema) if known is not None else asked.mapInPandas(read, schema), "stamps")
    if path and not words.where("fresh").isEmpty():
        # Each run writes into a folder of its own, so two at once don't disturb each other.
        words.where("fresh").select(*_WORDS.names).write.option("compression", "zstd").parquet(f"{path}/part-{uuid.uuid4().hex}")
    return words


def normalise(rows: DataFrame, host_clock: DataFrame, raw: str, host: str, source: str | None = None, dictionary: str | None = None) -> DataFrame:
    """rows with three more columns: stamp_status, stamp_micros (UTC microseconds, null unless resolved) and stamp_rest (written
    digits beyond microseconds).

    source, a column or null, names where a stamp comes from. dictionary is the folder of the kept dictionary, by default that of
    the shared folder. Blank, null and unreadable spellings are kept with their status; an unknown or null host has no
    zone. Rows without spelling never reach the join: they are undated by definition. Spellings that are frequent now,
    so that they would overload one task, are joined by broadcast, of which there are fewer than HOT_PARTS. _raw, _host, _source,
    _zone and _order are the operator's own columns: those of rows are dropped.
    """
    path = dictionary or dictionary_path(rows.sparkSession)
    named = F.coalesce(F.col(source), F.lit("")) if source else F.lit("")
    clocked = with_clock(rows.withColumns({"_raw": F.col(raw), "_host": F.col(host), "_source": named}), host_clock)
    lacking = F.col("_raw").isNull() | (F.trim("_raw") == "")
    given = clocked.where(~lacking)
    words = build_dictionary(given.select(*_KEYS), path)
    total = words.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("_n") > max(total // HOT_PARTS, 1000)
    lookup = words.select(*_KEYS, *(F.col(c).alias(f"_{c}") for c in ("status", "micros", "rest", "n")))
    hot, cold = lookup.where(is_hot).drop("_n"), lookup.where(~is_hot).drop("_n")
    out = given.join(cold, _KEYS)
    if not hot.isEmpty():
        out = given.join(broadcast(hot.select(*_KEYS)), _KEYS, "left_anti").join(cold, _KEYS).unionByName(given.join(broadcast(hot), _KEYS))
    made = {"_status": "stamp_status", "_micros": "stamp_micros", "_rest": "stamp_rest"}
    out = out.drop(*made.values()).withColumnsRenamed(made)
    none = clocked.where(lacking).withColumns({"stamp_status": F.lit(UNDATED), "stamp_micros": F.lit(None).cast("long"), "stamp_rest": F.lit(None).cast("string")})
    return out.unionByName(none).drop(*_KEYS, "_host")


def instant_text(micros: str = "stamp_micros", rest: str = "stamp_rest") -> Column:
    """The instant in ISO form with as many digits as were written beyond microseconds."""
    return F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.coalesce(F.col(rest), F.lit("")), F.lit("Z"))


def instant(micros: Column) -> Column:
    """Microseconds as a timestamp of the session's (UTC) zone."""
    return F.timestamp_micros(micros)


def stamp_rows(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_name, row_id, host_id, raw) of several tables, each given as (frame, id column, stamp column)."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("row_id"), "host_id", F.col(col).alias("raw")) for name, (df, key, col) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
