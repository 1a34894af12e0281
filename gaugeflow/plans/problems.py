"""Queries of the data-quality problems p1 to p6 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.units import ALIASES
from gaugeflow.operators.common_units import to_common_units
from gaugeflow.operators.drift import TYPES, column_changes, column_lifespans, one_table, typed_cells
from gaugeflow.operators.instants import to_instants
from gaugeflow.operators.nearby import boxes_of, containing, located, near_pairs
from gaugeflow.operators.regular_grid import missing_slots, regular_series
from gaugeflow.operators.spikes import flag_spikes
from gaugeflow.session import cut
from gaugeflow.sources.tables import table

PH = "fakesite_phmeasurements_2025_cybele"
NEAR_M = 250.0


def _flags(spark: SparkSession, folder: str, fence: float | None) -> DataFrame:
    return flag_spikes(table(spark, folder, PH), source="platform", when="measurement_date", key="id", value="ph", low=0, high=14, fence=fence)


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder, fence=6.0).withColumns({c: F.round(c, 6) for c in ("value", "level", "scatter")})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder, fence=None).select(F.col("key").alias("id")).filter("id is not null").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    slots = missing_slots(table(spark, folder, "sensor_messages"), table(spark, folder, "sensor_kinds"))
    return slots.select(F.col("source").alias("platform"), (F.col("slot") * F.col("period") * 1_000_000).alias("slot_start_us"))


def p2_series(spark: SparkSession, folder: str) -> DataFrame:
    found = regular_series(table(spark, folder, "sensor_messages"), table(spark, folder, "sensor_kinds"))
    return found.withColumns({c: F.round(c, 4) for c in ("pressure_kpa", "temperature_c")})


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    found = to_common_units(table(spark, folder, "raw_records"), table(spark, folder, "table_columns"))
    return found.select("record_id", "file_id", "ordinal", "quantity", F.round("reading", 6).alias("reading"), F.round("value", 4).alias("value"), "converted")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = to_common_units(table(spark, folder, "raw_records"), table(spark, folder, "table_columns"), converted_only=True)
    return cases.select("record_id", "ordinal", F.round(F.col("value") * 10).cast("bigint").alias("value_tenths")).distinct()


def _instants(spark: SparkSession, folder: str, distinct: bool) -> DataFrame:
    slope = table(spark, folder, "slope_readings").select(F.lit("slope_readings").alias("source_table"), F.lit("timestamp").alias("field_name"), "platform", F.col("reading_id").alias("row_key"), F.col("timestamp").alias("text"), "logger_tz")
    items = table(spark, folder, "stac_items").select("item_no", "properties.platform", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"properties.{c}").alias("text")) for c in ("start_datetime", "end_datetime")])).alias("_f"))
    items = items.select(F.lit("stac_items").alias("source_table"), "_f.field_name", "platform", F.col("item_no").alias("row_key"), "_f.text", F.lit(None).cast("string").alias("logger_tz"))
    # the three fields are read together; a source is a platform in one field, a key a row of a table
    rows = slope.unionByName(items).withColumns({"source": F.to_json(F.struct("field_name", "platform")), "key": F.struct("source_table", "field_name", "platform", "row_key")})
    found = to_instants(rows, source="source", key="key", text="text", zone="logger_tz", distinct=distinct)
    return found.select("key.source_table", "key.field_name", F.col("key.platform").alias("source"), F.col("key.row_key").alias("key"), "text", "utc_us", "form", "posterior", "status")


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder, distinct=True).withColumn("posterior", F.round("posterior", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = _instants(spark, folder, distinct=False).filter("status = 'converted'")
    return cases.select("source_table", "field_name", F.col("key").alias("row_key"), "utc_us").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return column_changes(table(spark, folder, "insitu_files"), table(spark, folder, "table_columns"))


def p5_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return column_lifespans(table(spark, folder, "insitu_files"), table(spark, folder, "table_columns"))


def p5_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = typed_cells(table(spark, folder, "raw_records"), table(spark, folder, "table_columns"))
    return cells.withColumn("instant_us", F.unix_micros("instant")).drop("instant")


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = one_table(table(spark, folder, "raw_records"), table(spark, folder, "table_columns"))
    return rows.withColumn("others", F.to_json("others"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # read once: both relations use the distinct places several times
    points = cut(located(table(spark, folder, PH), "platform", "location"))
    near = near_pairs(points, NEAR_M)
    within = containing(points, boxes_of(table(spark, folder, "stac_items"), "id", "bbox"))
    near = near.select(F.lit("near").alias("relation"), "key_a", "key_b")
    return near.unionByName(within.select(F.lit("within").alias("relation"), F.col("key").alias("key_a"), F.col("region").alias("key_b")))


QUERIES = {f.__name__: f for f in (p1_found, p1_flags, p2_found, p2_series, p3_found, p3_values, p4_found, p4_instants, p5_found, p5_catalogue, p5_cells, p5_table, p6_found)}

def _instants_sql(every: bool = False) -> str:
    """One CASE for each form of text; the earlier of two instants for an hour that occurs twice. every: all texts, with form and status."""
    clock, zone = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?", r" ?(z|[+-]\d{2}(?::?\d{2})?|utc|gmt|[a-z]{3,4})?"
    forms = {
        "iso": (r"(\d{4})-(\d{2})-(\d{2})[t ]" + clock + zone, "y m d h n s f z"),
        "basic": (r"(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})" + zone, "y m d h n s z"),
        "ordinal": (r"(\d{4})-(\d{3})[t ]" + clock + zone, "y j h n s f z"),
        "mail": (r"(?:[a-z]{3}, )?(\d{1,2}) ([a-z]{3}) (\d{4}) " + clock + zone, "d b y h n s f z"),
        "half": (r"(\d{1,2})/(\d{1,2})/(\d{4}) " + clock + r" ?([ap])m", "m d y h n s f a"),
        "day": (r"(\d{1,2})[./](\d{1,2})[./](\d{4}) " + clock + zone, "d m y h n s f z"),
    }
    keys = "y m d j b h n s f a z".split()
    cases = []
    for pattern, names in forms.values():
        groups = ", ".join(f"'{n}'" for n in names.split())
        parts = ", ".join(f"x.{k}" if k in names.split() else "''" for k in keys)
        cases.append(f"when regexp_full_match(t, '{pattern}') then (select [{parts}] from (select regexp_extract(t, '^{pattern}$', [{groups}]) x))")
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    named = " ".join(f"when regexp_full_match(t, '{pattern}') then '{ {'half': 'month_first_12h', 'day': 'day_first'}.get(name, name)}'" for name, (pattern, _) in forms.items())
    digits = "case when n < 100000000000 then 's' when n < 100000000000000 then 'ms' when n < 100000000000000000 then 'us' else 'ns' end"
    canonical = r"regexp_full_match(text, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ')"
    kept = "" if every else f"where text is not null and not {canonical}"
    status = f"case when utc_us is null then 'none' when {canonical} then 'canonical' else 'converted' end"
    last = (
        f"select distinct source_table, field_name, platform source, row_key as key, text, utc_us::bigint utc_us, case when utc_us is not null then case when n is not null then {digits} else case {named} end end end form, case when utc_us is not null then 1.0::double end posterior, {status} status from o"
        if every
        else "select distinct source_table, field_name, row_key, utc_us::bigint utc_us from o where utc_us is not null"
    )
    offsets = "case p[11] when 'z' then 0 when 'utc' then 0 when 'gmt' then 0 when 'wet' then 0 when 'west' then 60 when 'cet' then 60 when 'cest' then 120 when 'mst' then -420 when 'mdt' then -360 end"
    return rf"""
with r as (select 'slope_readings' source_table, 'timestamp' field_name, reading_id row_key, timestamp as text, coalesce(logger_tz, 'UTC') tz, platform from slope_readings
  union select 'stac_items', 'start_datetime', item_no, properties.start_datetime, 'UTC', properties.platform from stac_items union select 'stac_items', 'end_datetime', item_no, properties.end_datetime, 'UTC', properties.platform from stac_items),
t as (select *, lower(trim(text)) t from r {kept}),
p as (select *, case {" ".join(cases)} end p, case when regexp_full_match(t, '\d{{9,20}}') then t::hugeint end n from t),
w as (select *, (case when p[4] <> '' then try_cast(p[1] || '-01-01' as date) + (try_cast(p[4] as int) - 1)
    else try_cast(p[1] || '-' || lpad(case when p[5] <> '' then list_position({months}, p[5])::varchar else p[2] end, 2, '0') || '-' || lpad(p[3], 2, '0') as date) end)::timestamp
  + to_hours(case when p[10] = '' then p[6]::int else p[6]::int % 12 + (p[10] = 'p')::int * 12 end) + to_minutes(p[7]::int) + to_seconds(coalesce(try_cast(p[8] as int), 0))
  + to_microseconds(coalesce(try_cast(rpad(left(p[9], 6), 6, '0') as int), 0) * (p[9] <> '')::int) wall from p),
z as (select *, epoch_us(timezone(tz, wall)) late from w),
o as (select source_table, field_name, row_key, platform, text, t, n, case
  when n is not null then case when n < 100000000000 then n * 1000000 when n < 100000000000000 then n * 1000 when n < 100000000000000000 then n else n // 1000 end
  when p[11] similar to '[+-].*' then epoch_us(wall) - (case when p[11][1] = '-' then -1 else 1 end * (substr(p[11], 2, 2)::int * 60 + coalesce(try_cast(right(replace(p[11][4:], ':', ''), 2) as int), 0))) * 60000000::bigint
  when p[11] <> '' then epoch_us(wall) - {offsets} * 60000000::bigint
  when timezone(tz, make_timestamptz(late - 3600000000)) = wall then late - 3600000000 else late end utc_us from z)
{last}"""


_MESSAGES = """
m as (select platform, lower(trim(sensor_type)) kind, epoch_us(cast(timestamp as timestamptz)) us from sensor_messages
      where timestamp >= '2000' and (pressure_kpa is not null or (temperature_c is not null and not isnan(temperature_c)))),
t as (select platform, max(kind) kind from m group by platform),
s as (select distinct m.platform, k.period_s * 1000000::bigint period, m.us // (k.period_s * 1000000::bigint) slot
      from m join t using (platform) join sensor_kinds k on k.sensor_type = t.kind),
g as (select *, lead(slot) over (partition by platform order by slot) following from s)"""



def _spikes_sql(fence: float | None = None) -> str:
    """Runs, ranges and short runs that stand off, by windows over whole platforms; exact quartiles. fence: all reasons of all flags."""
    med = "(list_aggregate({0}, 'median'))"
    near = ", ".join(f"lag(v, {i}) over w p{i}, lead(v, {i}) over w n{i}" for i in range(1, 8))
    past, coming = "[" + ", ".join(f"p{i}" for i in range(1, 8)) + "]", "[" + ", ".join(f"n{i}" for i in range(1, 8)) + "]"
    ends = ", ".join(f"lag(b, {j}) over w b{j}, lead(a, {j}) over w a{j}" for j in (1, 2))

    def at(i: int) -> str:
        return "v" if i == 0 else f"p{-i}" if i < 0 else f"n{i}"

    spans = []
    for length in (1, 2, 3):
        for j in range(length):
            b, a = (f"b{j}" if j else "b"), (f"a{length - 1 - j}" if length - 1 - j else "a")
            off = ", ".join(f"abs({at(i)} - {side})" for i in range(-j, length - j) for side in (b, a))
            spans.append(f"({b} is not null and {a} is not null and least({off}) >= 8 * s and greatest(abs({at(-j - 1)} - {b}), abs({at(length - j)} - {a})) < 8 * s)")
    if fence is None:
        last = f"select id from h where frozen or not (v between 0 and 14) union select id from x join q using (platform) where {' or '.join(spans)}"
    else:
        beyond = lambda v, low, high: f"{v} < {low} - {fence} * greatest({high} - {low}, 0.01) or {v} > {high} + {fence} * greatest({high} - {low}, 0.01)"
        last = f"""select platform source, id as key, round(v, 6) as value, reason, round(l, 6) as level, round(s, 6) scatter from (
  select platform, id, v, case when not (v between 0 and 14) then 'range' else 'frozen' end reason, null::double l, null::double s from h where frozen or not (v between 0 and 14)
  union all select platform, id, v, case when {' or '.join(spans)} then 'spike' when {beyond('v - l', 'q1', 'q3')} then 'fence' when {beyond('rate', 'r1', 'r3')} then 'rate' end, l, s
  from x join q using (platform)) where reason is not null"""
    return f"""
with d as (select distinct id, platform, measurement_date t, ph::double v from {PH} where ph is not null),
r as (select *, count(*) over f = 8 and min(v) over f = max(v) over f e from d window f as (partition by platform order by t, id rows 7 preceding)),
h as (select *, max(e) over (partition by platform order by t, id rows between current row and 7 following) frozen from r),
g as (select id, platform, t, v, lag(t) over w tp, {near} from h where not frozen and v between 0 and 14 window w as (partition by platform order by t, id)),
m as (select *, abs(v - p1) / nullif(date_diff('day', tp, t), 0) rate, {med.format(past)} b, {med.format(coming)} a, {med.format(f"list_concat({past}, {coming})")} l from g),
q as (select platform, greatest((quantile_disc(v - l, 0.75) - quantile_disc(v - l, 0.25)) / 1.349, 0.005) s,
  quantile_disc(v - l, 0.25) q1, quantile_disc(v - l, 0.75) q3, quantile_disc(rate, 0.25) r1, quantile_disc(rate, 0.75) r3 from m group by 1),
x as (select *, {ends} from m window w as (partition by platform order by t, id))
{last}"""


#: For SQL: each quantity's names and its units' texts in lower case, with what they are worth.
_UNIT_ROWS = {
    "pressure": "kpa 1 0|hpa 0.1 0|mbar 0.1 0|bar 100 0|psi 6.894757 0|lbf/in2 6.894757 0|mh2o 9.80665 0|m h2o 9.80665 0",
    "temperature": "c 1 0|°c 1 0|degc 1 0|celsius 1 0|k 1 -273.15|kelvin 1 -273.15|f 0.5555555555555556 -17.77777777777778|°f 0.5555555555555556 -17.77777777777778|degf 0.5555555555555556 -17.77777777777778|fahrenheit 0.5555555555555556 -17.77777777777778",
    "deformation": "mm 1 0|cm 10 0|m 1000 0|um 0.001 0|µm 0.001 0|in 25.4 0|inch 25.4 0|\" 25.4 0",
    "level": "m 1 0|cm 0.01 0|mm 0.001 0|ft 0.3048 0|feet 0.3048 0|' 0.3048 0",
    "flow": "l/s 1 0|l_s 1 0|lps 1 0|l/min 0.016666666666666666 0|l_min 0.016666666666666666 0|lpm 0.016666666666666666 0|m3/h 0.2777777777777778 0|m³/h 0.2777777777777778 0|m3_h 0.2777777777777778 0|cmh 0.2777777777777778 0|gpm 0.0630901964 0",
}


def _columns_sql() -> str:
    """CTEs u (quantity, unit, factor, shift) and c (file_id, ordinal, name, type, quantity, unit) of all headers."""
    rows = []
    for quantity, units in _UNIT_ROWS.items():
        for text in units.split("|"):
            unit, factor, shift = text.rsplit(" ", 2)
            unit = unit.replace("'", "''")
            rows.append(f"('{quantity}', '{unit}', {factor}, {shift})")
    kinds = " ".join(f"when regexp_matches(name, '^({'|'.join(sorted(names.split(), key=len, reverse=True))})(_.+)?$') then '{q}'" for q, names in ALIASES.items())
    every = "|".join(sorted(" ".join(ALIASES.values()).split(), key=len, reverse=True))
    return f"""u(quantity, unit, factor, shift) as (values {", ".join(rows)}),
n as (select distinct file_id, ordinal, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') name, lower(trim(type)) type from table_columns),
k as (select *, case {kinds} end quantity, regexp_extract(name, '^({every})_(.+)$', 2) unit from n),
c as (select k.file_id, ordinal, name, type, case when k.unit = '' or u.unit is not null then k.quantity end quantity, k.unit from k left join u on u.quantity = k.quantity and u.unit = k.unit)"""


def _units_sql() -> str:
    return f"""
with {_columns_sql()},
r as (select distinct record_id, file_id, cells from raw_records),
e as (select record_id, ordinal, quantity, c.unit named, trim(cells[ordinal], '  ') cell from r join c using (file_id) where quantity is not null),
p as (select *, regexp_extract(cell, '^([+-]?[0-9][0-9 ]*(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?) *([^0-9].*)?$', ['number', 'unit']) x from e),
v as (select record_id, ordinal, quantity, lower(case when x.unit <> '' then x.unit else named end) unit, try_cast(replace(replace(x.number, ' ', ''), ',', '.') as double) value from p)
select distinct record_id, ordinal, round((value * factor + shift) * 10)::bigint value_tenths from v join u using (quantity, unit)
where value is not null and value <> -9999 and not (factor = 1 and shift = 0)"""


def _values_sql() -> str:
    """All cells with a value, converted or not."""
    return _units_sql().split("select distinct record_id, ordinal")[0].replace("select record_id, ordinal, quantity, lower(", "select record_id, file_id, ordinal, quantity, lower(").replace("select record_id, ordinal, quantity, c.unit", "select record_id, file_id, ordinal, quantity, c.unit") + """select distinct record_id, file_id, ordinal, v.quantity, round(value, 6) reading,
round(value * coalesce(factor, 1) + coalesce(shift, 0), 4) as value, not (coalesce(factor, 1) = 1 and coalesce(shift, 0) = 0) converted
from v left join u on u.quantity = v.quantity and u.unit = v.unit where value is not null and value <> -9999 and (coalesce(v.unit, '') = '' or factor is not null)"""


_SERIES_SQL = f"""with {_MESSAGES},
d as (select distinct message_id, platform, lower(trim(sensor_type)) kind, epoch_us(cast(timestamp as timestamptz)) us, pressure_kpa p, case when isnan(temperature_c) then null else temperature_c end c from sensor_messages
  where platform is not null and timestamp >= '2000' and (pressure_kpa is not null or (temperature_c is not null and not isnan(temperature_c)))),
o as (select platform, k.period_s * 1000000::bigint period from t join sensor_kinds k on k.sensor_type = t.kind)
select platform source, us // period * period slot_start_us, count(*) n_messages, round(avg(p), 4) pressure_kpa, round(avg(c), 4) temperature_c, false missing from d join o using (platform) group by 1, 2
union all select platform, unnest(range(slot + 1, following)) * period, 0, null, null, true from g where following > slot + 1"""


def _drift_sql() -> str:
    return f"""
with {_columns_sql()},
f as (select file_id, field, min(struct_pack(ordinal, name, type)) x from (select *, coalesce('quantity:' || quantity, name) field from c) group by 1, 2),
s as (select file_id, lag(file_id) over (partition by feed order by period_start, file_id) before from (select distinct feed, period_start, file_id from insitu_files)),
new as (select s.file_id, field, x from s join f using (file_id) where before is not null),
old as (select s.file_id, field, x from s join f on f.file_id = s.before),
j as (select file_id, field, old.x o, new.x n from old full join new using (file_id, field))
select file_id, 'added' as change, '' as old_name, n.name as new_name from j where o is null
union all select file_id, 'removed', o.name, '' from j where n is null
union all select file_id, 'renamed', o.name, n.name from j where o.name <> n.name
union all select file_id, 'retyped', o.name, n.name from j where o.type <> n.type"""


_TYPES_SQL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPES.items()) + " else 'string' end"


def _fields_sql() -> str:
    """CTEs f (file_id, field, ordinal, name, type) and y (field, cast_to) after those of _columns_sql."""
    return f"""{_columns_sql()},
g as (select file_id, field, min(struct_pack(ordinal, name, type)) x from (select *, coalesce('quantity:' || quantity, name) field from c) group by 1, 2),
f as (select file_id, field, x.ordinal ordinal, x.name as name, x.type as type from g),
y as (select field, case when field like 'quantity:%' then 'double' when count(distinct k) = 1 then any_value(k) when bool_and(k in ('double', 'bigint')) then 'double' else 'string' end cast_to
  from (select field, {_TYPES_SQL} k from f) group by 1)"""


def _lifespans_sql() -> str:
    return f"""
with {_fields_sql()},
p as (select feed, period_start, file_id, row_number() over (order by feed, period_start, file_id) pos, lead(file_id) over (partition by feed order by period_start, file_id) after
  from (select distinct feed, period_start, file_id from insitu_files)),
i as (select *, pos - row_number() over (partition by feed, field, name, type order by pos) island from p join f using (file_id)),
s as (select feed, field, name, type, min(struct_pack(pos, file_id, period_start)) a, max(struct_pack(pos, file_id, period_start, after)) z, count(*) n_files from i group by feed, field, name, type, island)
select feed, field, name, type, a.file_id first_file, z.file_id last_file, a.period_start first_period, z.period_start last_period, n_files, z.after ended_by, cast_to from s join y using (field)"""


def _cells_sql() -> str:
    return f"""
with {_fields_sql()},
r as (select distinct record_id, file_id, line_no, cells from raw_records),
l as (select record_id, file_id, line_no, field, cast_to, cells[ordinal] raw from r join f using (file_id) join y using (field) where field not like 'quantity:%' and cells[ordinal] is not null),
v as (select *, case when cast_to = 'double' then try_cast(raw as double) when cast_to = 'bigint' then try_cast(raw as bigint)::double when cast_to = 'boolean' then try_cast(raw as boolean)::int::double end number,
  case when cast_to in ('timestamp', 'date') then epoch_us(try_cast(raw as timestamptz)) end instant_us from l)
select record_id, file_id, line_no, field, cast_to, number, instant_us, case when number is null and instant_us is null then raw end as text from v"""


#: Equivalent SQL of those queries that SQL can express in a few lines; the others are tested by brute force.
ORACLE = {
    "p1_found": _spikes_sql(),
    "p1_flags": _spikes_sql(fence=6.0),
    "p2_series": _SERIES_SQL,
    "p3_values": _values_sql(),
    "p4_instants": _instants_sql(every=True),
    "p3_found": _units_sql(),
    "p4_found": _instants_sql(),
    "p5_found": _drift_sql(),
    "p5_catalogue": _lifespans_sql(),
    "p5_cells": _cells_sql(),
    "p2_found": f"with {_MESSAGES} select platform, unnest(range(slot + 1, following)) * period as slot_start_us from g where following > slot + 1",
    "p6_found": """
with p as (select distinct platform, location.lon lon, location.lat lat from fakesite_phmeasurements_2025_cybele
           where location.lon is not null and location.lat is not null and not (location.lon = 0 and location.lat = 0)),
i as (select distinct id, case when len(bbox) = 6 then [bbox[1], bbox[2], bbox[4], bbox[5]] else bbox end b from stac_items where len(bbox) in (4, 6)),
near as (select distinct 'near' relation, a.platform key_a, b.platform key_b from p a join p b
         on a.platform < b.platform and b.lat between a.lat - 0.00225 and a.lat + 0.00225
         where 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 250),
within_ as (select distinct 'within' relation, platform key_a, id key_b from p join i on p.lat between b[2] and b[4]
            and case when b[1] <= b[3] then p.lon between b[1] and b[3] else p.lon >= b[1] or p.lon <= b[3] end)
select * from near union all select * from within_""",
}
