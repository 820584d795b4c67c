"""Queries of the data problems tagged general, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.text import BLANKS, NO_VALUE
from loomgrid.operators.grid import regular_series
from loomgrid.operators.orphans import orphan_references
from loomgrid.operators.spikes import _TAIL, BINS, FEW, MARGIN, MARKS, MEASURES, RISK, SCALES_DIFFER, SERVED, SHAPES_DIFFER, implausible
from loomgrid.operators.timestamps import ABBREVIATIONS, call_times, received_times, zone_table
from loomgrid.session import table

VALIDITY = ("gtfs_active_date", "gtfs_end_date")


def _orphans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parents = {"trip_id": (table(spark, folder, "schedule_trips"), "trip_id", *VALIDITY), "stop_id": (table(spark, folder, "schedule_stops"), "stop_id", *VALIDITY)}
    return orphan_references(table(spark, folder, "schedule_calls"), "call_id", "gtfs_active_date", parents)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)[0].select(F.col("row_id").alias("call_id"), F.col("domain").alias("ref_field"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references per referenced table and period."""
    name = F.when(F.col("domain") == "trip_id", "schedule_trips").otherwise("schedule_stops")
    return _orphans(spark, folder)[1].groupBy(name.alias("parent_table"), F.col("period").alias("gtfs_active_date")).agg(F.count(F.lit(1)).alias("missing_ids"), F.sum("n").alias("dangling_calls"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(table(spark, folder, "replay")).select("row_id", "field_name")


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(table(spark, folder, "replay")).groupBy("field_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    manifest = table(spark, folder, "manifest").select("manifest_id", F.col("extraction.timezone").alias("zone_text"))
    zones = zone_table(manifest, "manifest_id", "zone_text")
    return received_times(table(spark, folder, "replay_received"), zones).unionByName(call_times(table(spark, folder, "schedule_calls"), zones))


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    source = [F.col("service_date"), F.col("parent_station"), F.col("direction_id").cast("int").alias("direction_id")]
    return regular_series(table(spark, folder, "replay"), source, F.col("move_timestamp"), F.col("parent_station").isNotNull())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_grid(spark, folder).filter("status <> 'observed'").select("service_date", "parent_station", "direction_id", "period_start")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_reasons, p3_found, p6_found, p6_grid)}

_ID = "lower(trim({}, E' \\t\\n\\r'))"
_DANGLING = f"""
SELECT c.call_id, c.gtfs_active_date, r.ref_field, r.ref FROM schedule_calls c,
LATERAL (VALUES ('trip_id', {_ID.format('c.trip_id')}), ('stop_id', {_ID.format('c.stop_id')})) r(ref_field, ref)
WHERE r.ref <> '' AND CASE r.ref_field
  WHEN 'trip_id' THEN NOT EXISTS (SELECT 1 FROM schedule_trips t WHERE {_ID.format('t.trip_id')} = r.ref AND c.gtfs_active_date BETWEEN t.gtfs_active_date AND t.gtfs_end_date)
  ELSE NOT EXISTS (SELECT 1 FROM schedule_stops s WHERE {_ID.format('s.stop_id')} = r.ref AND c.gtfs_active_date BETWEEN s.gtfs_active_date AND s.gtfs_end_date) END"""
_SERIES = """
WITH b AS (
  SELECT service_date, parent_station, CAST(direction_id AS INT) AS direction_id, move_timestamp // 300 * 300 AS period_start, count(*) AS readings, max(move_timestamp) AS last_reading
  FROM replay WHERE move_timestamp > 0 AND parent_station IS NOT NULL GROUP BY ALL),
s AS (SELECT service_date, parent_station, direction_id, min(period_start) AS a, max(period_start) AS z FROM b GROUP BY ALL),
g AS (SELECT service_date, parent_station, direction_id, unnest(range(a, z + 300, 300)) AS period_start FROM s),
j AS (SELECT g.*, b.readings, b.last_reading FROM g LEFT JOIN b USING (service_date, parent_station, direction_id, period_start))"""

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|[+-]\d{2}:?(?:\d{2})?|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}))?"
_PARTS = {
    "e4": (r"(\d{4})-(\d{2})-(\d{2})(?:T|\s+)" + _CLOCK + _ZONE, "y o d h m s f z"), "e5": (r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})" + _ZONE, "y o d h m s z"),
    "e6": (r"(\d{1,2})[.](\d{1,2})[.](\d{4})\s+" + _CLOCK + _ZONE, "d o y h m s f z"), "e7": (r"(\d{1,2})/(\d{1,2})/(\d{4})\s+" + _CLOCK + r"(?:\s*([AP])[.]?M[.]?)?" + _ZONE, "o d y h m s f p z"),
    "e8": (r"(?:[A-Z]{3},\s*)?(\d{1,2})\s+([A-Z]{3})\s+(\d{4})\s+" + _CLOCK + _ZONE, "d n y h m s f z"), "e9": (_CLOCK + r"(?:\s*([AP])[.]?M[.]?)?(?:[+](\d))?", "h m s f p x"),
    "e10": (r"(\d{1,2})[.](\d{2})(?:[.](\d{2}))?", "h m s"), "e1": (r"(\d{10}|\d{13}|\d{16}|\d{19})", "e"), "e2": (r"(\d{10})[.](\d{1,9})", "e ef"), "e3": (r"(\d{1,9})", "b"),
    "e11": (r"(P)(?:(\d{1,3})D)?(?:T(?:(\d{1,4})H)?(?:(\d{1,6})M)?(?:(\d{1,8})S)?)?", "pt dd dh dm ds"),
}


def _off(u: str) -> str:
    return f"(CASE WHEN fixed IS NOT NULL THEN fixed ELSE CAST(epoch(timezone(zone, to_timestamp({u}))) AS BIGINT) - ({u}) END)"


def _instant(local: str) -> str:
    """The one instant of a local second; null if there is none or more than one."""
    a, z = f"({local} - {_off(f'{local} - 86400')})", f"({local} - {_off(f'{local} + 86400')})"
    fits = lambda u: f"({u} + {_off(u)} = {local})"
    return f"CASE WHEN {a} = {z} THEN CASE WHEN {fits(a)} THEN {a} END WHEN {fits(a)} AND {fits(z)} THEN NULL WHEN {fits(a)} THEN {a} WHEN {fits(z)} THEN {z} END"


def _times() -> str:
    extract = ", ".join(f"regexp_extract(v, '(?i)^{p}$', [{', '.join(repr(n) for n in names.split())}]) AS {e}" for e, (p, names) in _PARTS.items())
    every = sorted({n for _, names in _PARTS.values() for n in names.split()})
    joined = ", ".join(f"nullif({' || '.join(f'{e}.{n}' for e, (_, names) in _PARTS.items() if n in names.split())}, '') AS {n}" for n in every)
    blanks = "'" + BLANKS.replace("'", "''") + "'"
    short = ", ".join(f"('{a}', {o * 60})" for a, o in ABBREVIATIONS.items())
    digits = "CASE WHEN length(zd) <= 2 THEN lpad(zd, 2, '0') || '00' ELSE lpad(zd, 4, '0') END"
    return rf"""WITH ab AS (SELECT * FROM (VALUES {short}) a(name, seconds)), zn AS (SELECT lower(name) AS l, min(name) AS name FROM pg_timezone_names() GROUP BY 1),
mz AS (SELECT manifest_id, lower(trim(extraction.timezone, {blanks})) AS l FROM manifest), mo AS (SELECT *, regexp_extract(l, '^(?:utc|gmt)?([+-])(\d{{1,2}})(?::?(\d{{2}}))?$', ['g', 'h', 'm']) AS o FROM mz),
mf AS (SELECT manifest_id, CASE WHEN o.g <> '' AND CAST(o.h AS INT) <= 14 THEN (CAST(o.h AS INT) * 3600 + coalesce(TRY_CAST(o.m AS INT), 0) * 60) * CASE o.g WHEN '-' THEN -1 ELSE 1 END ELSE ab.seconds END AS fixed, zn.name AS zone FROM mo LEFT JOIN ab ON lower(ab.name) = l LEFT JOIN zn USING (l)),
t AS (SELECT 'received' AS record_kind, raw_id AS record_id, 'stop_timestamp' AS field_name, stop_timestamp AS v, service_date AS day, manifest_id FROM replay_received WHERE NOT regexp_full_match(stop_timestamp, '[0-9]{{10}}')
UNION ALL SELECT 'call', call_id, 'arrival_time', arrival_time, gtfs_active_date, manifest_id FROM schedule_calls WHERE NOT regexp_full_match(arrival_time, '[0-9]{{2}}:[0-5][0-9]:[0-5][0-9]')
UNION ALL SELECT 'call', call_id, 'departure_time', departure_time, gtfs_active_date, manifest_id FROM schedule_calls WHERE NOT regexp_full_match(departure_time, '[0-9]{{2}}:[0-5][0-9]:[0-5][0-9]')),
s AS (SELECT record_kind, record_id, field_name, trim(v, {blanks}) AS v, TRY_CAST(strptime(CAST(day AS VARCHAR), '%Y%m%d') AS DATE) AS day, fixed, zone FROM t LEFT JOIN mf USING (manifest_id) WHERE trim(v, {blanks}) <> ''),
x AS (SELECT record_kind, record_id, field_name, day, fixed, zone, {extract} FROM s), c AS (SELECT record_kind, record_id, field_name, day, fixed, zone, {joined} FROM x),
n AS (SELECT *, coalesce(o, lpad(CAST(nullif(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(n)), 0) AS VARCHAR), 2, '0')) AS mon, upper(z) AS zu, regexp_replace(z, '[^0-9]', '', 'g') AS zd, CAST(m AS INT) AS mi, coalesce(CAST(s AS INT), 0) AS se,
  CASE WHEN p IS NULL THEN CAST(h AS INT) WHEN CAST(h AS INT) BETWEEN 1 AND 12 THEN CAST(h AS INT) % 12 + CASE upper(p) WHEN 'P' THEN 12 ELSE 0 END END AS ho, coalesce(CAST(rpad(substr(coalesce(ef, f), 1, 6), 6, '0') AS BIGINT), 0) AS micro FROM c),
g AS (SELECT *, CASE WHEN mi < 60 AND se < 60 THEN ho * 3600 + mi * 60 + se END AS hms, CASE WHEN CAST(y AS INT) >= 1 AND ho < 24 THEN TRY_CAST(y || '-' || lpad(mon, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) END AS dt, (day - DATE '1970-01-01') * 86400 + 43200 AS noon,
  CASE WHEN zd <> '' THEN CASE WHEN CAST(substr({digits}, 1, 2) AS INT) <= 18 AND CAST(substr({digits}, 3, 2) AS INT) < 60 THEN (CAST(substr({digits}, 1, 2) AS INT) * 3600 + CAST(substr({digits}, 3, 2) AS INT) * 60) * CASE WHEN contains(z, '-') THEN -1 ELSE 1 END END ELSE (SELECT seconds FROM ab WHERE ab.name = zu) END AS zoff FROM n),
l AS (SELECT *, (dt - DATE '1970-01-01') * 86400 + hms AS local FROM g),
i AS (SELECT *, CASE WHEN z IS NULL THEN {_instant('local')} ELSE local - zoff END AS found, {_instant('noon')} AS midday, CASE length(e) WHEN 10 THEN CAST(e AS BIGINT) * 1000000 WHEN 13 THEN CAST(e AS BIGINT) * 1000 WHEN 16 THEN CAST(e AS BIGINT) WHEN 19 THEN CAST(CAST(e AS HUGEINT) // 1000 AS BIGINT) END + CASE WHEN ef IS NULL THEN 0 ELSE micro END AS epoch_micros,
  coalesce(CASE WHEN y IS NULL AND ((x IS NULL AND p IS NULL) OR ho < 24) THEN hms + coalesce(CAST(x AS INT), 0) * 86400 END, CASE WHEN pt IS NOT NULL AND coalesce(dd, dh, dm, ds) IS NOT NULL THEN coalesce(CAST(dd AS BIGINT), 0) * 86400 + coalesce(CAST(dh AS BIGINT), 0) * 3600 + coalesce(CAST(dm AS BIGINT), 0) * 60 + coalesce(CAST(ds AS BIGINT), 0) END) AS clock FROM l),
r AS (SELECT *, coalesce(epoch_micros, found * 1000000 + micro) AS micros FROM i)
SELECT record_kind, record_id, field_name, CAST(coalesce(CASE record_kind WHEN 'received' THEN coalesce(micros, (midday - 43200 + clock) * 1000000 + CASE WHEN y IS NULL AND f IS NOT NULL THEN micro ELSE 0 END)
  ELSE coalesce(CAST(floor(micros / 1000000) AS BIGINT) - midday + 43200, clock, CASE WHEN length(b) = 6 THEN CASE WHEN substr(b, 3, 2) < '60' AND substr(b, 5, 2) < '60' THEN CAST(substr(b, 1, 2) AS BIGINT) * 3600 + CAST(substr(b, 3, 2) AS BIGINT) * 60 + CAST(substr(b, 5, 2) AS BIGINT) END WHEN length(b) < 6 THEN CAST(b AS BIGINT) END) END, -1) AS BIGINT) AS norm_value FROM r"""


def _bins_at(p: float, step: str | None) -> str:
    """The bin, or the place within its step, that a share of the values reaches."""
    place = "bin" if step is None or p == 0.5 else f"bin + 1.0::DOUBLE * {step} * (({p!r}::DOUBLE * alln - upto + n) / n - 0.5::DOUBLE)"
    return f"arg_min({place}, bin) FILTER (WHERE upto >= ceil({p!r}::DOUBLE * alln))"


def _quantiles(of: str, by: str, at: dict[str, float], step: str | None) -> str:
    return f"(SELECT {by}, max(alln) AS size, {', '.join(f'{_bins_at(p, step)} AS {n}' for n, p in at.items())} FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS alln FROM {of}) GROUP BY {by})"


def _shapes(of: str) -> str:
    apart = lambda a, b: f"greatest(abs({a} - {b}), 0.25::DOUBLE)"
    each = ", ".join(f"{apart(f'{t}1', f'{t}2')} AS {t}_near, ln({apart(f'{t}1', f'{t}3')}) AS {t}_scale, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, log2({apart(f'{t}3', f'{t}4')} / {apart(f'{t}1', f'{t}2')}) / 2)) AS {t}_shape" for t in "lh")
    return f"(SELECT *, {each} FROM {of})"


def _usual(of: str) -> str:
    return f"(SELECT field, {', '.join(f'quantile_cont({t}_{c}, 0.5) AS {t}_usual_{c}' for t in 'lh' for c in ('shape', 'scale'))} FROM {of}, range(CAST(size AS BIGINT)) WHERE size >= {FEW} GROUP BY 1)"


def _cutoff(t: str, step: str) -> str:
    coarse = lambda width: f"pow(1.0::DOUBLE * {step} / {width}, 2)"
    drawn = lambda c, own: f"({own} * {t}_{c} + (1 - {own}) * coalesce({t}_usual_{c}, {t}_{c}))"
    own_shape = f"({SHAPES_DIFFER**2!r}::DOUBLE / ({SHAPES_DIFFER**2!r}::DOUBLE + 54.0::DOUBLE / size + 0.17::DOUBLE * {coarse(f'{t}_near')}))"
    shape = f"least(-0.01::DOUBLE, greatest(-0.5::DOUBLE, {drawn('shape', own_shape)}))"
    error = f"(15.6::DOUBLE / size + {coarse(f'exp({t}_scale)')} / 6)"
    own_scale = f"({SCALES_DIFFER**2!r}::DOUBLE / ({SCALES_DIFFER**2!r}::DOUBLE + {error}))"
    scale = f"exp(greatest({t}_scale, {drawn('scale', own_scale)} + {MARGIN!r}::DOUBLE * sqrt({own_scale} * {error})))"
    grown = lambda k: f"(exp({shape} * {k!r}::DOUBLE) - 1)"
    return f"{t}1 {'+' if t == 'h' else '-'} {scale} * {grown(math.log(0.1 / RISK))} / {grown(math.log(4.0))}"


def _cutoffs(of: str, usual: str, step: str, keys: str, names: dict[str, str]) -> str:
    return f"(SELECT {keys}, size, mid, {', '.join(f'{_cutoff(t, step)} AS {n}' for t, n in names.items())} FROM {of} LEFT JOIN {usual} USING (field))"


def _spikes() -> str:
    blanks, words = "'" + BLANKS.replace("'", "''") + "'", "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in NO_VALUE) + ")"
    word = lambda c: f"CASE WHEN lower(trim({c}, {blanks})) NOT IN {words} THEN upper(trim({c}, {blanks})) END"
    usual = lambda by, v, name: f"(SELECT {by}, arg_min({v}, (-n, {v})) AS {name} FROM (SELECT {by}, {v}, count(*) AS n FROM w WHERE {v} IS NOT NULL GROUP BY {by}, {v}) GROUP BY {by})"
    trip, call = "service_date, route_id, direction_id, start_time", "service_date, vehicle, field, route_id, direction_id, start_time, stop_sequence"
    column = {"stop": "stop", "station": "station", "trunk": "trunk", "direction_id": "CAST(direction_id AS VARCHAR)"}
    fields = ", ".join(f"{{'field': '{m.name}', 'source': concat_ws(chr(1), {', '.join(f'coalesce({column[c]}, chr(2))' for c in m.source)}), 'value': {m.name}, 'bad': {m.name} <= {m.at_most_impossible} OR {m.name} > {m.most} OR {m.name} IN ({', '.join(map(str, MARKS))})}}" for m in MEASURES)
    law = lambda threshold, by: _shapes(_quantiles(f"(SELECT {by}, bin - {threshold} AS bin, sum(n) AS n FROM us GROUP BY {by}, bin - {threshold})", by, _TAIL, "1.0::DOUBLE"))
    step = "greatest(1.0::DOUBLE, {0} / exp({1} / {0}))".format(f"{float(BINS)!r}::DOUBLE", "{}")
    same = " AND ".join(f"k.{c} IS NOT DISTINCT FROM z.{c}" for c in [*call.split(", "), "value"])
    return f"""WITH w AS (SELECT row_id, {trip}, stop_sequence, {word('stop_id')} AS stop, {word('parent_station')} AS own_station, regexp_replace({word('trunk_route_id')}, '^T-', '') AS own_trunk, regexp_replace({word('vehicle_id')}, '[^A-Z0-9]', '', 'g') AS own_vehicle,
  coalesce(CASE WHEN stop_timestamp > 0 THEN stop_timestamp END, CASE WHEN move_timestamp > 0 THEN move_timestamp END) AS seen, {', '.join(m.name for m in MEASURES)} FROM replay),
sv AS (SELECT route_id, own_trunk, true AS served FROM (SELECT route_id, own_trunk, count(*) AS n FROM w WHERE route_id IS NOT NULL AND own_trunk IS NOT NULL GROUP BY 1, 2) QUALIFY n >= {SERVED!r}::DOUBLE * sum(n) OVER (PARTITION BY route_id)),
pr AS (SELECT row_id, {trip}, stop_sequence, seen, stop, coalesce(own_station, usual_station) AS station, coalesce(CASE WHEN served THEN own_trunk END, usual_trunk, own_trunk) AS trunk, coalesce(usual_vehicle, own_vehicle) AS vehicle, {', '.join(m.name for m in MEASURES)}
  FROM w LEFT JOIN {usual('stop', 'own_station', 'usual_station')} USING (stop) LEFT JOIN {usual('route_id', 'own_trunk', 'usual_trunk')} USING (route_id) LEFT JOIN sv USING (route_id, own_trunk) LEFT JOIN {usual(trip, 'own_vehicle', 'usual_vehicle')} USING ({trip})),
lo AS (SELECT row_id, {trip}, stop_sequence, vehicle, coalesce(seen // 3600 % 24, -1) AS hour, e.field AS field, e.source AS source, e.value AS value, e.bad AS bad, CASE WHEN NOT e.bad THEN CAST(round(ln(greatest(e.value, 1) + 1.0::DOUBLE) * {BINS}) AS BIGINT) END AS bin
  FROM (SELECT *, unnest([{fields}]) AS e FROM pr) WHERE e.value IS NOT NULL),
bi AS (SELECT field, source, hour, bin, count(*) AS n FROM lo WHERE bin IS NOT NULL GROUP BY ALL),
sh AS (SELECT * FROM {_shapes(_quantiles('(SELECT field, source, bin, sum(n) AS n FROM bi GROUP BY ALL)', 'field, source', _TAIL, step.format('bin')))}),
lv AS (SELECT * FROM {_cutoffs('sh', _usual('sh'), step.format('mid'), 'field, source', {'l': 'level_low', 'h': 'level_high'})}),
se AS (SELECT q.field, q.source, q.hour, CASE WHEN q.size >= {FEW} THEN q.low ELSE CAST(round(sh.l1) AS BIGINT) END AS season_low, CASE WHEN q.size >= {FEW} THEN q.middle ELSE CAST(round(sh.mid) AS BIGINT) END AS season, CASE WHEN q.size >= {FEW} THEN q.high ELSE CAST(round(sh.h1) AS BIGINT) END AS season_high
  FROM {_quantiles('bi', 'field, source, hour', {'low': 0.1, 'middle': 0.5, 'high': 0.9}, None)} q JOIN sh ON sh.field = q.field AND sh.source = q.source),
us AS (SELECT bi.*, season_low, season, season_high FROM bi JOIN se USING (field, source, hour)), ol AS (SELECT * FROM {law('season_low', 'field, source')}), oh AS (SELECT * FROM {law('season_high', 'field, source')}), op AS (SELECT * FROM {law('season', 'field')}),
rl AS (SELECT * FROM {_cutoffs('ol', _usual('ol'), '1.0::DOUBLE', 'field, source', {'l': 'residual_low'})}), rh AS (SELECT * FROM {_cutoffs('oh', _usual('oh'), '1.0::DOUBLE', 'field, source', {'h': 'residual_high'})}), po AS (SELECT * FROM {_cutoffs('op', _usual('sh'), '1.0::DOUBLE', 'field', {'l': 'pooled_low', 'h': 'pooled_high'})}),
ju AS (SELECT row_id, lo.field, bin, lv.size >= {FEW} AS own, bin - CASE WHEN lv.size < {FEW} THEN lv.mid ELSE 0 END AS level, bin - CASE WHEN lv.size < {FEW} THEN season ELSE season_high END AS above, bin - CASE WHEN lv.size < {FEW} THEN season ELSE season_low END AS below, level_low, level_high, residual_low, residual_high, pooled_low, pooled_high
  FROM lo JOIN se USING (field, source, hour) JOIN lv USING (field, source) JOIN rl USING (field, source) JOIN rh USING (field, source) JOIN po ON po.field = lo.field WHERE bin IS NOT NULL),
sp AS (SELECT row_id, field FROM ju WHERE (level > CASE WHEN own THEN level_high ELSE pooled_high END AND above > CASE WHEN own THEN residual_high ELSE pooled_high END) OR (level < CASE WHEN own THEN level_low ELSE pooled_low END AND below < CASE WHEN own THEN residual_low ELSE pooled_low END)),
ca AS (SELECT DISTINCT {call}, value FROM lo WHERE vehicle IS NOT NULL), or1 AS (SELECT *, lag(value) OVER o AS before, lead(value) OVER o AS after, row_number() OVER o AS k FROM ca WINDOW o AS (PARTITION BY service_date, vehicle, field ORDER BY start_time NULLS FIRST, route_id NULLS FIRST, direction_id NULLS FIRST, stop_sequence NULLS FIRST, value)),
or2 AS (SELECT *, CASE WHEN before IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS new FROM or1), or3 AS (SELECT *, sum(new) OVER (PARTITION BY service_date, vehicle, field ORDER BY k) AS run FROM or2), or4 AS (SELECT *, count(*) OVER (PARTITION BY service_date, vehicle, field, run) AS length FROM or3),
ch AS (SELECT field, 1 + ceil({math.log(RISK)!r}::DOUBLE / ln(least(greatest(count(*) FILTER (WHERE new = 1 AND after = value) / nullif(count(*) FILTER (WHERE new = 1 AND after IS NOT NULL), 0), 0.002::DOUBLE), 0.9::DOUBLE))) AS least_run FROM or4 GROUP BY 1),
lr AS (SELECT or4.* FROM or4 JOIN ch USING (field) WHERE length >= greatest(least_run, 5)),
st AS (SELECT k.row_id, k.field FROM lo k WHERE vehicle IS NOT NULL AND EXISTS (SELECT 1 FROM lr z WHERE {same})),
fo AS (SELECT row_id, field AS field_name, min(reason) AS reason FROM (SELECT row_id, field, 'impossible' AS reason FROM lo WHERE bad UNION ALL SELECT *, 'spike' FROM sp UNION ALL SELECT *, 'stuck' FROM st) GROUP BY 1, 2)"""


SQL = {
    "p2_found": _spikes() + " SELECT row_id, field_name FROM fo",
    "p2_reasons": _spikes() + " SELECT field_name, reason, count(*) AS n FROM fo GROUP BY 1, 2",
    "p3_found": _times(),
    "p1_found": f"SELECT call_id, ref_field FROM ({_DANGLING})",
    "p1_report": f"""SELECT CASE ref_field WHEN 'trip_id' THEN 'schedule_trips' ELSE 'schedule_stops' END AS parent_table, gtfs_active_date,
count(DISTINCT ref) AS missing_ids, count(*) AS dangling_calls FROM ({_DANGLING}) GROUP BY ALL""",
    "p6_found": _SERIES + " SELECT service_date, parent_station, direction_id, period_start FROM j WHERE readings IS NULL",
    "p6_grid": _SERIES
    + """,
l AS (SELECT *, last_value(CASE WHEN readings IS NOT NULL THEN period_start END IGNORE NULLS) OVER w AS seen, last_value(last_reading IGNORE NULLS) OVER w AS carried
  FROM j WINDOW w AS (PARTITION BY service_date, parent_station, direction_id ORDER BY period_start))
SELECT service_date, parent_station, direction_id, period_start, coalesce(readings, 0) AS readings,
  CASE WHEN period_start - seen <= 900 THEN carried END AS last_reading, CASE WHEN period_start - seen <= 900 THEN period_start + 299 - carried END AS age_s,
  CASE WHEN readings IS NOT NULL THEN 'observed' WHEN period_start - seen <= 900 THEN 'carried' ELSE 'missing' END AS status FROM l""",
}
