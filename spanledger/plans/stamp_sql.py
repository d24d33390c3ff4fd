"""Stamps in DuckDB SQL: the rules of TESTDATA.md for mixed spellings, for the SQL beside queries that read them."""

from __future__ import annotations

from ..operators.stamps import ZONE_MINUTES

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d{2}:?\d{2}|[+-]\d{1,2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)?"
_FORMS = {
    "iso": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt]|\s+)" + _TIME + _ZONE, "y mo d h mi s f z"),
    "basic": (r"(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE, "y mo d h mi s f z"),
    "mail": (r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})\s+" + _TIME + _ZONE, "d mon y h mi s f z"),
    "slash": (r"(\d{1,2})/(\d{1,2})/(\d{4})(?:[Tt]|,?\s+)" + _TIME + r"\s*([AaPp]\.?[Mm]\.?)?" + _ZONE, "a b y h mi s f ap z"),
}
_FIELDS = "y mo d mon a b h mi s f ap z".split()
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_SHIFTS = ("INTERVAL 30 MINUTE", "INTERVAL 1 HOUR", "INTERVAL 2 HOUR")


def _form(name: str) -> str:
    pattern, groups = _FORMS[name]
    at = {g: f"x.{g}" for g in groups.split()}
    fields = ", ".join(f"{at.get(g, repr(''))} AS {g}" for g in _FIELDS)
    listed = ", ".join(f"'{g}'" for g in groups.split())
    return f"SELECT k, zone, ord, {fields} FROM (SELECT k, zone, ord, regexp_extract(t, '^{pattern}$', [{listed}]) AS x FROM @_t WHERE form = '{name}')"


def stamped(name: str, rows: str) -> str:
    """Common table expressions that end in `name`: k, status, micros, rest of the rows of a SELECT of k, raw and host_id."""
    minutes = "map {" + ", ".join(f"'{z}': {m}" for z, m in ZONE_MINUTES.items()) + "}"
    form = " ".join(f"WHEN regexp_full_match(t, '{p}') THEN '{n}'" for n, (p, _) in _FORMS.items())
    date = "try_cast(y || '-' || lpad({mo}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    both = [date.format(mo=m, d=d) for m, d in (("a", "b"), ("b", "a"))]
    twice = " OR ".join(f"timezone(zone, u {sign} {shift}) = local" for shift in _SHIFTS for sign in "+-")
    return f"""
@_clock AS (SELECT host_id, CASE WHEN min(zone_name) = max(zone_name) THEN max(zone_name) END AS zone, CASE WHEN min(date_order) = max(date_order) THEN max(date_order) END AS ord FROM host_clock WHERE host_id IS NOT NULL GROUP BY host_id),
@_t AS MATERIALIZED (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'none' WHEN regexp_full_match(t, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') THEN 'number' {form} ELSE 'other' END AS form
  FROM (SELECT i.k, c.zone, c.ord, trim(i.raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM ({rows}) i LEFT JOIN @_clock c ON c.host_id = i.host_id)),
@_num AS (SELECT k, v <= 0 AS none, whole || substr(part, 1, shift) AS digits, regexp_replace(substr(part, shift + 1), '0+$', '') AS rest FROM (SELECT *, rpad(part0, greatest(shift, length(part0))::INTEGER, '0') AS part FROM (
  SELECT k, try_cast(t AS DOUBLE) AS v, CASE WHEN try_cast(t AS DOUBLE) > 1e14 THEN 0 WHEN try_cast(t AS DOUBLE) > 1e11 THEN 3 ELSE 6 END AS shift, regexp_extract(t, '^[+-]?(\\d*)', 1) AS whole, regexp_extract(t, '[.](\\d*)$', 1) AS part0 FROM @_t WHERE form = 'number'))),
@_f AS ({" UNION ALL ".join(_form(n) for n in _FORMS)}),
@_d AS (SELECT k, zone, z, f, CASE WHEN a = '' AND mon = '' THEN [{date.format(mo="mo", d="d")}] WHEN mon <> '' THEN [{date.format(mo=f"cast(list_position({_MONTHS}, lower(mon[1:3])) AS VARCHAR)", d="d")}]
    WHEN ord = 'mdy' THEN [{both[0]}] WHEN ord = 'dmy' THEN [{both[1]}] ELSE [{both[0]}, {both[1]}] END AS days,
    CASE WHEN ap = '' THEN try_cast(h AS INTEGER) WHEN try_cast(h AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(h AS INTEGER) % 12 + CASE WHEN upper(ap[1:1]) = 'P' THEN 12 ELSE 0 END ELSE 99 END AS hour, try_cast(mi AS INTEGER) AS minute, coalesce(try_cast(s AS INTEGER), 0) AS second FROM @_f),
@_l AS (SELECT k, zone, z, f, CASE WHEN len(ds) = 1 AND hour < 24 AND minute < 60 AND second < 60 THEN cast(ds[1] AS TIMESTAMP) + to_microseconds(((hour * 60 + minute) * 60 + second)::BIGINT * 1000000 + try_cast(rpad(substr(f, 1, 6), 6, '0') AS BIGINT)) END AS local
  FROM (SELECT *, list_distinct(list_filter(days, lambda x: x IS NOT NULL)) AS ds FROM @_d)),
@_z AS (SELECT *, {minutes}[upper(z)] AS named, regexp_extract(CASE WHEN upper(z)[1:3] IN ('UTC', 'GMT') THEN z[4:] ELSE z END, '^([+-])(\\d{{1,2}}):?(\\d{{2}})?$', ['g', 'hh', 'mm']) AS o, CASE WHEN zone IN (SELECT name FROM pg_timezone_names()) AND z = '' THEN timezone(zone, local) END AS u FROM @_l),
@_i AS (SELECT k, regexp_replace(substr(f, 7), '0+$', '') AS rest, CASE WHEN z = '' THEN CASE WHEN timezone(zone, u) = local AND NOT ({twice}) THEN epoch_us(u) END
    WHEN named IS NOT NULL THEN epoch_us(local) - named::BIGINT * 60000000
    WHEN o.g <> '' AND coalesce(try_cast(o.mm AS BIGINT), 0) < 60 AND try_cast(o.hh AS BIGINT) * 60 + coalesce(try_cast(o.mm AS BIGINT), 0) <= 1080
      THEN epoch_us(local) - (try_cast(o.hh AS BIGINT) * 60 + coalesce(try_cast(o.mm AS BIGINT), 0)) * CASE WHEN o.g = '-' THEN -60000000 ELSE 60000000 END END AS micros FROM @_z),
@ AS (SELECT k, 'undated' AS status, cast(NULL AS BIGINT) AS micros, cast(NULL AS VARCHAR) AS rest FROM @_t WHERE form = 'none' UNION ALL SELECT k, 'unresolved', NULL, NULL FROM @_t WHERE form = 'other'
  UNION ALL SELECT k, CASE WHEN none THEN 'undated' WHEN m IS NULL THEN 'unresolved' ELSE 'resolved' END, m, CASE WHEN m IS NOT NULL THEN rest END FROM (SELECT *, CASE WHEN NOT none AND length(ltrim(digits, '0')) <= 18 THEN try_cast(digits AS BIGINT) END AS m FROM @_num)
  UNION ALL SELECT k, CASE WHEN micros IS NULL THEN 'unresolved' ELSE 'resolved' END, micros, CASE WHEN micros IS NOT NULL THEN rest END FROM @_i)""".replace("@", name)
