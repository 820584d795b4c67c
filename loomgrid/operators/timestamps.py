"""Mixed timestamp formats and time zones, normalised to one number.

All formats are one alternation of a regular expression with named groups. A value passes the expression once: a single
replacement writes out every group, and a split gives the components. Calendar ranges are then checked and instants are
assembled by integer arithmetic on days; nothing is parsed twice and nothing leaves the JVM.

Zones come from a small table of manifests. Local times are resolved by trying the zone's offsets of the day before
and of the day after: an instant counts if it reads as the same local time again. None or two of them make the time impossible
to fix. Zone abbreviations in a value are fixed offsets.

Defined cases: null and blank values are no values. Values that match no format, that have ranges exceeded or that need a zone where
none is known give -1. Texts of any length are matched whole. Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.text import stripped

# Offsets of zone abbreviations from UTC in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: What a zone at the end of a value looks like.
_ZONE = r"(?<z{0}>Z|[+-]\d{{2}}:?(?:\d{{2}})?|(?:UTC|GMT)[+-]\d{{1,2}}(?::?\d{{2}})?|[A-Z]{{2,5}})"
_CLOCK = r"(?<h{0}>\d{{1,2}}):(?<m{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d{{1,9}}))?)?"

#: The alternation. Groups: y, o, d (date), n (month's name), h, m, s, f (clock), p (am or pm), z (zone), e and ef (epoch), b (bare digits), D, H, M, S (duration), x (days later).
FORMATS = (
    r"(?<e1>\d{10}|\d{13}|\d{16}|\d{19})",
    r"(?<e2>\d{10})[.](?<ef2>\d{1,9})",
    r"(?<b3>\d{1,9})",
    r"(?<y4>\d{4})-(?<o4>\d{2})-(?<d4>\d{2})(?:T|\s+)" + _CLOCK.format(4) + r"(?:\s*" + _ZONE.format(4) + r")?",
    r"(?<y5>\d{4})(?<o5>\d{2})(?<d5>\d{2})T(?<h5>\d{2})(?<m5>\d{2})(?<s5>\d{2})(?:\s*" + _ZONE.format(5) + r")?",
    r"(?<d6>\d{1,2})[.](?<o6>\d{1,2})[.](?<y6>\d{4})\s+" + _CLOCK.format(6) + r"(?:\s*" + _ZONE.format(6) + r")?",
    r"(?<o7>\d{1,2})/(?<d7>\d{1,2})/(?<y7>\d{4})\s+" + _CLOCK.format(7) + r"(?:\s*(?<p7>[AP])[.]?M[.]?)?(?:\s*" + _ZONE.format(7) + r")?",
    r"(?:[A-Z]{3},\s*)?(?<d8>\d{1,2})\s+(?<n8>[A-Z]{3})\s+(?<y8>\d{4})\s+" + _CLOCK.format(8) + r"(?:\s*" + _ZONE.format(8) + r")?",
    _CLOCK.format(9) + r"(?:\s*(?<p9>[AP])[.]?M[.]?)?(?:[+](?<x9>\d))?",
    r"(?<h10>\d{1,2})[.](?<m10>\d{2})(?:[.](?<s10>\d{2}))?",
    r"(?<pt>P)(?:(?<D>\d{1,3})D)?(?:T(?:(?<H>\d{1,4})H)?(?:(?<M>\d{1,6})M)?(?:(?<S>\d{1,8})S)?)?",
)
_COMPONENTS = ("e", "ef", "b", "y", "o", "d", "n", "h", "m", "s", "f", "p", "z", "x", "pt", "D", "H", "M", "S")
_MARK = "\u0001"


def _groups(component: str) -> list[str]:
    import re

    return re.findall(rf"\(\?<({component}\d*)>", "|".join(FORMATS))


def _components(text: Column) -> Column:
    """A struct of text components, null where a value has none; the field `form` is null where no format fits."""
    everything = "(?i)^(?:" + "|".join(FORMATS) + ")$"
    out = _MARK + _MARK.join("".join("${" + g + "}" for g in _groups(c)) for c in _COMPONENTS)
    return F.split(F.regexp_replace(text, everything, out), _MARK)


def days_of(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, in integers."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400).cast("long")
    yoe = yy - era * 400
    mp = (m + 9) % 12
    doy = F.floor((mp * 153 + 2) / 5).cast("long") + d - 1
    doe = yoe * 365 + F.floor(yoe / 4).cast("long") - F.floor(yoe / 100).cast("long") + doy
    return era * 146_097 + doe - 719_468


def valid_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def zone_table(frame: DataFrame, key: str, zone: str) -> DataFrame:
    """(key, zone): zones by their names in the zone database or as +hh:mm, whatever their spelling; null where no zone is known or a key has several.
    The names are a table of the zone database: some hundred rows, whatever the data."""
    spark = frame.sparkSession
    fixed = {a.lower(): f"{'-' if o < 0 else '+'}{abs(o) // 60:02}:{abs(o) % 60:02}" for a, o in ABBREVIATIONS.items()}
    # the zones that the engine itself knows: only those can be computed with
    names = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]").split(", ")
    known = {n.lower(): n for n in sorted(names)} | fixed
    by_name = spark.createDataFrame(list(known.items()), "lower string, name string")
    lower = F.lower(stripped(F.col(zone)))
    offset = r"^(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    part = lambda i: F.regexp_extract("lower", offset, i)
    minutes = F.when(part(3) == "", "00").otherwise(part(3))
    return (
        frame.select(F.col(key), lower.alias("lower"))
        .join(F.broadcast(by_name), "lower", "left")
        .select(key, F.coalesce(F.when(F.col("lower").rlike(offset) & (F.lpad(part(2), 2, "0") <= "14"), F.concat(part(1), F.lpad(part(2), 2, "0"), F.lit(":"), minutes)), "name").alias("zone"))
        .groupBy(key)
        .agg(F.count_distinct("zone").alias("n"), F.max("zone").alias("zone"))
        .select(key, F.when(F.col("n") == 1, F.col("zone")).alias("zone"))
    )


def _resolved(local: str, zone: str) -> Column:
    """SQL: the one instant (seconds) of a local second in a zone; null if there is none or more than one."""
    near = lambda shift: f"(unix_seconds(from_utc_timestamp(timestamp_seconds({local} {shift}), {zone})) - ({local} {shift}))"
    before, after = f"({local} - {near('- 86400')})", f"({local} - {near('+ 86400')})"
    reads = lambda u: f"(unix_seconds(from_utc_timestamp(timestamp_seconds({u}), {zone})) = {local})"
    return F.expr(
        f"case when {zone} is null or {local} is null or {local} not between -62000000000 and 250000000000 then null when {before} = {after} then case when {reads(before)} then {before} end "
        f"when {reads(before)} and {reads(after)} then null when {reads(before)} then {before} when {reads(after)} then {after} end"
    )


def parsed(rows: DataFrame, text: str, day: str, zone: str) -> DataFrame:
    """Adds `_micros` (instant in UTC epoch microseconds, from dated and epoch values), `_clock` (seconds on the clock of the service day, from
    bare clocks and durations), `_bare` (the digits of a short run of digits) and `_midday` (instant in seconds of local noon of the service day)."""
    at = {c: i + 1 for i, c in enumerate(_COMPONENTS)}
    parts = rows.withColumn("_t", stripped(F.col(text))).withColumn("_c", _components(F.col("_t")))
    got = lambda c: F.when(F.size("_c") > len(_COMPONENTS), F.nullif(F.get("_c", F.lit(at[c])), F.lit("")))
    number = lambda c: got(c).cast("long")
    parts = parts.select(
        *rows.columns,
        *[got(c).alias(f"_{c}") for c in ("e", "ef", "b", "n", "f", "p", "z", "x", "pt")],
        *[number(c).alias(f"_long_{c}") for c in ("D", "H", "M", "S")],
        *[number(c).alias(f"_{c}") for c in ("y", "o", "d", "h", "m", "s")],
    )
    month = F.coalesce(F.col("_o"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower("_n")), F.lit(0)))
    parts = parts.withColumn("_o", month).withColumn("_s", F.coalesce("_s", F.lit(0).cast("long")))
    twelve = F.col("_h").between(1, 12)
    hour = F.when(F.col("_p").isNull(), F.col("_h")).when(twelve, F.col("_h") % 12 + F.when(F.upper("_p") == "P", 12).otherwise(0))
    parts = parts.withColumn("_h", hour).withColumn("_hms", F.when((F.col("_m") < 60) & (F.col("_s") < 60), F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_s")))
    fraction = F.coalesce(F.rpad(F.substring(F.coalesce("_ef", "_f"), 1, 6), 6, "0").cast("long"), F.lit(0).cast("long"))
    dated = F.col("_y").isNotNull() & valid_date(F.col("_y"), F.col("_o"), F.col("_d")) & (F.col("_h") < 24)
    parts = parts.withColumn("_local", F.when(dated, days_of(F.col("_y"), F.col("_o"), F.col("_d")) * 86_400 + F.col("_hms"))).withColumn("_fraction", fraction)
    # the zone that a value names
    z = F.upper("_z")
    digits = F.regexp_replace(F.regexp_replace(z, "^(UTC|GMT)(?=[+-])", ""), "[^0-9]", "")
    digits = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    numeric = F.when((hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(z.contains("-"), -1).otherwise(1))
    table = F.create_map(*[x for a, o in ABBREVIATIONS.items() for x in (F.lit(a), F.lit(o * 60))])
    parts = parts.withColumn("_offset", F.when(z.rlike("[0-9]"), numeric).otherwise(F.try_element_at(table, z)))
    known = {10: 1_000_000, 13: 1_000, 16: 1}
    epoch = F.when(F.length("_e") == 19, F.floor(F.col("_e").cast("decimal(20,0)") / 1000).cast("long"))
    for n, k in known.items():
        epoch = epoch.when(F.length("_e") == n, F.col("_e").cast("decimal(20,0)").cast("long") * k)
    day_days = days_of(F.expr(f"cast({day} as bigint) div 10000"), F.expr(f"(cast({day} as bigint) div 100) % 100"), F.expr(f"cast({day} as bigint) % 100"))
    good_day = valid_date(F.expr(f"cast({day} as bigint) div 10000"), F.expr(f"(cast({day} as bigint) div 100) % 100"), F.expr(f"cast({day} as bigint) % 100"))
    parts = parts.withColumn("_noon", F.when(good_day, day_days * 86_400 + 43_200)).withColumn("_midday", _resolved("_noon", zone))
    unzoned = F.when(F.col("_z").isNull(), F.col("_local"))
    parts = parts.withColumn("_unzoned", unzoned).withColumn("_found", F.when(F.col("_z").isNull(), _resolved("_unzoned", zone)).otherwise(F.col("_local") - F.col("_offset")))
    duration = F.when(
        F.col("_pt").isNotNull() & F.coalesce(*[F.col(f"_long_{c}") for c in "DHMS"]).isNotNull(),
        sum((F.coalesce(F.col(f"_long_{c}"), F.lit(0)) * k for c, k in (("D", 86_400), ("H", 3600), ("M", 60), ("S", 1))), F.lit(0).cast("long")),
    )
    clock = F.when(F.col("_y").isNull() & ((F.col("_x").isNull() & F.col("_p").isNull()) | (F.col("_h") < 24)), F.col("_hms") + F.coalesce(F.col("_x").cast("long"), F.lit(0)) * 86_400)
    return parts.select(
        *rows.columns,
        F.coalesce(epoch + F.when(F.col("_ef").isNotNull(), F.col("_fraction")).otherwise(0), F.col("_found") * 1_000_000 + F.col("_fraction")).alias("_micros"),
        F.coalesce(clock, duration).alias("_clock"),
        F.when(F.col("_y").isNull() & F.col("_f").isNotNull(), F.col("_fraction")).otherwise(0).alias("_clock_fraction"),
        F.col("_b").alias("_bare"),
        F.col("_midday").alias("_midday"),
    )


def _cases(rows: DataFrame, value: str, plain: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull() & (stripped(F.col(value)) != "") & ~F.col(value).rlike(plain))


def received_times(received: DataFrame, zones: DataFrame, value: str = "stop_timestamp", row_id: str = "raw_id", day: str = "service_date") -> DataFrame:
    """(record_kind, record_id, field_name, norm_value) of the instants that aren't ten digits. zones: manifest_id, zone."""
    rows = _cases(received.select(F.col(row_id).alias("record_id"), F.col(value).alias("_v"), F.col(day).alias("_day"), "manifest_id"), "_v", r"\A[0-9]{10}\z").join(zones, "manifest_id", "left")
    norm = F.coalesce(F.col("_micros"), (F.col("_midday") - 43_200 + F.col("_clock")) * 1_000_000 + F.col("_clock_fraction"), F.lit(-1).cast("long"))
    return parsed(rows, "_v", "_day", "zone").select(F.lit("received").alias("record_kind"), "record_id", F.lit(value).alias("field_name"), norm.alias("norm_value"))


def call_times(calls: DataFrame, zones: DataFrame, values: tuple[str, ...] = ("arrival_time", "departure_time"), row_id: str = "call_id", day: str = "gtfs_active_date") -> DataFrame:
    """(record_kind, record_id, field_name, norm_value) of the times of the service day that aren't HH:MM:SS."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("field_name"), F.col(v).alias("v")) for v in values]))
    rows = calls.select(F.col(row_id).alias("record_id"), F.col(day).alias("_day"), "manifest_id", each.alias("_e"))
    rows = rows.select("record_id", "_day", "manifest_id", F.col("_e.field_name").alias("field_name"), F.col("_e.v").alias("_v"))
    rows = _cases(rows, "_v", r"\A[0-9]{2}:[0-5][0-9]:[0-5][0-9]\z").join(zones, "manifest_id", "left")
    bare = F.col("_bare")
    six = F.when((F.substring(bare, 3, 2) < "60") & (F.substring(bare, 5, 2) < "60"), F.substring(bare, 1, 2).cast("long") * 3600 + F.substring(bare, 3, 2).cast("long") * 60 + F.substring(bare, 5, 2).cast("long"))
    seconds = F.when(F.length(bare) == 6, six).when(F.length(bare) < 6, bare.cast("long"))
    from_instant = F.floor(F.col("_micros") / 1_000_000).cast("long") - F.col("_midday") + 43_200
    norm = F.coalesce(from_instant, F.col("_clock"), seconds, F.lit(-1).cast("long"))
    return parsed(rows, "_v", "_day", "zone").select(F.lit("call").alias("record_kind"), "record_id", "field_name", norm.alias("norm_value"))
