"""Queries of the monitoring operators over whole tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import geometry, scores
from gaugeflow.functions.columns import normal_name
from gaugeflow.operators import audit, catalog, features, insar, joins, network, qc_service, quality, raster, risk, series
from gaugeflow.plans import ingestion
from gaugeflow.sources import detect, scenes, selection, text_files, weather
from gaugeflow.sources.tables import table
from gaugeflow.streaming import messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PH = "fakesite_phmeasurements_2025_cybele"


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL; dates come out as texts from both."""

    def keep(f: Query) -> Query:
        def texts(spark: SparkSession, folder: str) -> DataFrame:
            return f(spark, folder).withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[f.__name__] = texts if dates else f
        if sql:
            ORACLE[f.__name__] = f"select * replace ({', '.join(f'{d}::varchar as {d}' for d in dates)}) from ({sql})" if dates else sql
        return f

    return keep


def r(column: str | F.Column, digits: int = 6) -> F.Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(column) if isinstance(column, str) else F.round(c, digits)


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """A motion series: the daily sum of each user's events."""
    days = table(spark, folder, "events").groupBy(F.col("user_id").alias("cell_id"), F.to_date("ts").alias("date"))
    return days.agg(F.sum("value").alias("los_mm"))


def type_days(spark: SparkSession, folder: str) -> DataFrame:
    """Weather series: daily figures of each event type."""
    days = table(spark, folder, "events").groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("date"))
    return days.agg(F.sum("value").alias("precipitation_sum"), F.avg("value").alias("et0"), F.max("value").alias("temperature_max"))


_CELLS = "c as (select user_id cell_id, ts::date date, sum(value) los_mm from events group by 1, 2)"
_TYPES = "w as (select event_type location, ts::date date, sum(value) precipitation_sum, avg(value) et0, max(value) temperature_max from events group by 1, 2)"
_STEPS = f"""{_CELLS},
d as (select *, coalesce(los_mm - lag(los_mm) over u, 0) step, coalesce(nullif(date_diff('day', lag(date) over u, date), 0), 1) as days from c window u as (partition by cell_id order by date)),
s as (select *, abs(step / days) velocity from d)"""


def _score(x: str, low: float, high: float) -> str:
    return f"least(greatest(({x} - {low}) / ({high} - {low} + 1e-12), 0), 1)"


@query(f"""with {_STEPS}, {_TYPES},
p as (select location, date, sum(precipitation_sum) over (partition by location order by date rows 6 preceding) p7, temperature_max pm from w),
j as (select s.*, p7, pm from s left join p on p.date = s.date and p.location = (select min(location) from w)),
t as (select *, 100 * (0.45 * (0.40 * {_score("velocity", 0.5, 2)} + 0.35 * {_score("abs(step)", 0.5, 2)} + 0.25 * {_score("abs(los_mm)", 20, 60)})
     + 0.25 * {_score("p7", 20, 60)} + 0.15 * {_score("pm", 15, 35)}) score from j)
select cell_id, date, round(score, 3) risk_score,
  case when score >= 80 then 'Critical' when score >= 60 then 'High' when score >= 35 then 'Moderate' else 'Low' end risk_class from t""", dates=("date",))
def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    days = type_days(spark, folder)
    air = days.select("location", "date", F.col("temperature_max").alias("pm2_5"))
    rows = risk.risk_table(user_days(spark, folder), days, air)
    return rows.select("cell_id", "date", r("risk_score", 3), "risk_class")


@query(f"""with {_TYPES}
select location, date, round(sum(precipitation_sum) over a, 6) precip_7d_mm, round(sum(precipitation_sum) over b, 6) precip_30d_mm,
  (sum((precipitation_sum > 1)::int) over b)::bigint wet_days_30d, round(sum(precipitation_sum - et0) over b, 6) water_balance_30d_mm,
  round(temperature_max - avg(temperature_max) over b, 6) temp_max_month_anom
from w window a as (partition by location order by date rows 6 preceding), b as (partition by location order by date rows 29 preceding)""", dates=("date",))
def climate_rolling(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.climate_features(type_days(spark, folder))
    return rows.select("location", "date", r("precip_7d_mm"), r("precip_30d_mm"), "wet_days_30d", r("water_balance_30d_mm"), r("temp_max_month_anom"))


@query(f"""with d as (select distinct id, platform, measurement_date, ph::double ph from {PH} where ph is not null)
select id, platform, round(sum(ph) over (partition by platform order by measurement_date, id rows 6 preceding), 6) ph_7 from d""")
def rolling_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, PH).filter("ph is not null").select("id", "platform", "measurement_date", F.col("ph").cast("double").alias("ph")).distinct()
    return series.rolling_blocks(rows, "ph", 7, ["platform"], ["measurement_date", "id"], "ph_7").select("id", "platform", r("ph_7"))


@query(f"with {_STEPS} select cell_id, date, round(step, 6) step, days, round(velocity, 6) velocity from s", dates=("date",))
def first_difference(spark: SparkSession, folder: str) -> DataFrame:
    return series.steps(user_days(spark, folder), "los_mm", ["cell_id"], "date").select("cell_id", "date", r("step"), "days", r("velocity"))


@query("""with e as (select user_id, ts, value, lag(ts) over w p, lag(value) over w v from events window w as (partition by user_id order by ts, event_id))
select user_id, p as "start", ts as "end", round(value - v, 6) change, round((value - v) / (epoch_us(ts) - epoch_us(p)) * 86400000000, 4) rate from e where p is not null""")
def interval_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.intervals(table(spark, folder, "events"), "value", ["user_id"], "ts")
    return rows.select("user_id", "start", "end", r("change"), r("rate", 4))


@query(f"with {_CELLS} select cell_id, date, round(los_mm - first(los_mm) over (partition by cell_id order by date), 6) los_mm from c", dates=("date",))
def from_first_epoch(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.from_first(user_days(spark, folder), "los_mm", ["cell_id"], "date", "los_mm")
    return rows.select("cell_id", "date", r("los_mm"))


@query(f"""with {_CELLS}, p as (select *, lag(los_mm) over (partition by cell_id order by date) b from c)
select cell_id, round(arg_max(los_mm, date), 6) "last", round(max_by(los_mm, date) - max(b) filter (where date = m), 6) last_step
from (select *, max(date) over (partition by cell_id) m from p) group by cell_id""")
def last_change(spark: SparkSession, folder: str) -> DataFrame:
    return series.last_steps(user_days(spark, folder), "los_mm", ["cell_id"], "date").select("cell_id", r("last"), r("last_step"))


@query("""with d as (select user_id, ts::date date, max(value) value from events group by 1, 2),
g as (select user_id, unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date date from d group by 1)
select g.user_id, g.date, value from g left join d using (user_id, date)""", dates=("date",))
def daily_maximum(spark: SparkSession, folder: str) -> DataFrame:
    return series.daily_max(table(spark, folder, "events"), "ts", ["value"], ["user_id"])


@query(f"""with d as (select user_id, ts::date date, max(value) value from events group by 1, 2),
g as (select user_id, unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date date from d group by 1),
j as (select g.user_id, g.date, value from g left join d using (user_id, date))
select user_id, date, coalesce(last_value(value ignore nulls) over (partition by user_id order by date rows unbounded preceding),
  first_value(value ignore nulls) over (partition by user_id order by date rows between current row and unbounded following)) value from j""", dates=("date",))
def filled_days(spark: SparkSession, folder: str) -> DataFrame:
    days = series.daily_max(table(spark, folder, "events"), "ts", ["value"], ["user_id"])
    return series.filled_along(days, "value", ["user_id"], "date", "value").select("user_id", "date", "value")


@query(f"""with {_CELLS}, l as (select *, lag(los_mm) over w a, lead(los_mm) over w b from c window w as (partition by cell_id order by date))
select cell_id, date, round(case when a is null then b - los_mm when b is null then los_mm - a else (b - a) / 2 end, 6) gradient from l""", dates=("date",))
def line_gradient(spark: SparkSession, folder: str) -> DataFrame:
    return series.gradient(user_days(spark, folder), "los_mm", ["cell_id"], "date", "gradient").select("cell_id", "date", r("gradient"))


_NEAR = """with l as (select event_id, user_id, ts from events where event_type <> 'error'), x as (select user_id, ts, value from events where event_type = 'error'),
b as (select l.*, x.ts bts, x.value bv from l asof left join x on l.user_id = x.user_id and l.ts >= x.ts),
a as (select l.event_id, x.ts ats, x.value av from l asof left join x on l.user_id = x.user_id and l.ts <= x.ts)"""


@query(f"""{_NEAR} select event_id, user_id,
case when bts is null or ats is not null and epoch_us(ats) - epoch_us(ts) < epoch_us(ts) - epoch_us(bts) then ats else bts end nearest_ts,
case when bts is null or ats is not null and epoch_us(ats) - epoch_us(ts) < epoch_us(ts) - epoch_us(bts) then av else bv end nearest_value from b join a using (event_id)""")
def asof_nearest(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    left = events.filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'error'").select("user_id", "ts", "value")
    return series.nearest(left, right, keys=["user_id"], when="ts", right_when="ts", values=["value"]).drop("ts")


@query(f"{_NEAR} select event_id, user_id, round(case when epoch_us(ats) - epoch_us(bts) <= 432000000000 then bv + coalesce((epoch_us(ts) - epoch_us(bts)) / nullif(epoch_us(ats) - epoch_us(bts), 0), 0) * (av - bv) end, 6) linear_value from b join a using (event_id)")
def asof_linear(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    left = events.filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'error'").select("user_id", "ts", "value")
    rows = series.interpolated(left, right, keys=["user_id"], when="ts", right_when="ts", value="value", max_gap_s=5 * 86400)
    return rows.select("event_id", "user_id", r("linear_value"))


_TWO = "v as (select vec_id, embedding[1]::double lat, embedding[2]::double lon from embeddings)"


@query(f"""with {_TWO}, p as (select label::varchar as place, round(avg(embedding[1]::double), 9) lat, round(avg(embedding[2]::double), 9) lon from embeddings group by 1)
select v.vec_id, arg_min(place, pow(p.lat - v.lat, 2) + pow(p.lon - v.lon, 2)) as location from v, p group by 1""")
def nearest_place(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"))
    # a station for each label, in the middle of its vectors
    centre = [F.round(F.avg(F.col("embedding")[i].cast("double")), 9).alias(c) for i, c in enumerate(("lat", "lon"))]
    places = table(spark, folder, "embeddings").groupBy(F.col("label").cast("string").alias("location")).agg(*centre)
    return joins.nearest_location(points, places).select("vec_id", "location")


@query(f"""select platform, count(*) n_rows, sum((not (ph between 0 and 14))::int) range_rows from (select * from {PH} where ph is not null) group by 1""")
def qc_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, PH).filter("ph is not null").select("platform", "ph")
    return quality.check_readings(rows.withColumnRenamed("platform", "source"), "source").select(F.col("source").alias("platform"), "n_rows", "range_rows")


@query("""with k as (select platform, reading_id, count(*) c from slope_readings group by all), d as (select platform, sum(c - 1) duplicates from k group by 1),
f as (select platform, count(*) n_rows, sum((qc = 0)::int) fault_rows,
  sum((qc is distinct from 0 and (depth is null or def_x is null or def_y is null or def_z is null or velocity is null))::int) missing_rows,
  sum((qc is distinct from 0 and not coalesce(def_x between -100 and 100, true))::int) range_rows from slope_readings group by 1)
select platform, n_rows, duplicates::bigint duplicates, 0::bigint office_rows, fault_rows::bigint fault_rows, missing_rows::bigint missing_rows, range_rows::bigint range_rows,
  case when duplicates > 0 or fault_rows > 0 or range_rows > 0 then 'Fail' when missing_rows > 0 then 'Warn' else 'Pass' end status from f join d using (platform)""")
def qc_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "slope_readings").select("reading_id", F.col("platform").alias("source"), "platform", "depth", "def_x", "def_y", "def_z", "velocity", "qc")
    found = quality.check_readings(rows, "source", key="reading_id", qc="qc", platform="platform", limits={"def_x": (-100.0, 100.0)})
    return found.drop("missing_fraction").withColumnRenamed("source", "platform")


@query("select l_orderkey, l_linenumber, count(*) copies from lineitem group by all having count(*) > 1")
def qc_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select item_no, case when cc is null then 'Warn' when cc > 50 then 'Fail' else 'Pass' end status from
(select item_no, max(properties."eo:cloud_cover") cc from stac_items group by 1)""")
def qc_scenes(spark: SparkSession, folder: str) -> DataFrame:
    cover = F.col("properties.`eo:cloud_cover`")
    keys = F.when(cover.isNotNull(), F.array(F.lit("crs"), F.lit("cloud_cover_pct"), F.lit("sensor_type"))).otherwise(F.array(F.lit("crs")))
    rows = table(spark, folder, "stac_items").select("item_no", (cover / 100).alias("null_pixel_pct"), F.lit(True).alias("is_geometrically_aligned"), F.lit("optical").alias("sensor_type"), F.lit(40.0).alias("snr"), keys.alias("metadata_keys"))
    rows = rows.withColumn("null_pixel_pct", F.when(F.col("null_pixel_pct") > 0.5, 1.0).otherwise(0.0))
    return quality.check_scenes(rows).groupBy("item_no").agg(quality.worst(F.col("status")).alias("status"))


@query("select event_id, round(case when value < 0 then 0 when value <= 12 then 50 / 12.0 * value when value <= 35.4 then 49 / (35.4 - 12.1) * (value - 12.1) + 51 when value <= 55.4 then 49 / (55.4 - 35.5) * (value - 35.5) + 101 else 200 end, 6) aqi, round(least(greatest((value - 20) / (60 - 20 + 1e-12), 0), 1), 6) score from events")
def air_quality(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value")
    return table(spark, folder, "events").select("event_id", r(scores.us_aqi(v)).alias("aqi"), r(scores.linear_score(v, 20.0, 60.0)).alias("score"))


@query(f"with {_STEPS} select cell_id, date, (3 * (velocity >= 2)::int + 3 * (abs(step) >= 10)::int + 2 * (abs(los_mm) >= 50)::int)::int points from s", dates=("date",))
def map_risk(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.steps(user_days(spark, folder), "los_mm", ["cell_id"], "date")
    return rows.select("cell_id", "date", scores.raster_risk(F.col("velocity"), F.col("step"), F.col("los_mm"), F.lit(None).cast("double")).alias("points"))


@query("""with c as (select ts::date date, event_type s, count(distinct user_id) n from events group by 1, 2), m as (select s, max(n) n from c group by 1), d as (select distinct date from c)
select d.date, bool_and(coalesce(c.n, 0) = m.n) complete from d cross join m left join c on c.date = d.date and c.s = m.s group by 1""", dates=("date",))
def complete_dates(spark: SparkSession, folder: str) -> DataFrame:
    bursts = table(spark, folder, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("subswath"), F.col("user_id").alias("burst"))
    return insar.complete_dates(bursts)


@query("select user_id scene_id, " + ", ".join(f"round(sum((event_id % 12 = {i})::int) * 100.0 / count(*), 6) {n}" for i, n in enumerate(raster.CLASSES)) + ", round(sum((event_id % 12 in (8, 9, 10))::int) * 100.0 / count(*), 6) cloud from events group by 1")
def class_shares(spark: SparkSession, folder: str) -> DataFrame:
    return raster.class_shares(table(spark, folder, "events").select(F.col("user_id").alias("scene_id"), (F.col("event_id") % 12).cast("int").alias("scl")))


@query("""select (event_id // 100)::bigint "row", event_id % 100 col, median(value) b02 from (select user_id, event_id % 1000 event_id, value from events) group by 1, 2""")
def pixel_medians(spark: SparkSession, folder: str) -> DataFrame:
    place = F.col("event_id") % 1000
    return raster.pixel_medians(table(spark, folder, "events").select(F.floor(place / 100).alias("row"), (place % 100).alias("col"), F.col("value").alias("b02")), ["b02"])


@query("""with u as (select l_suppkey pair, l_extendedprice phase, l_discount corr, l_linenumber comp from lineitem where l_discount > 0 and l_linenumber > 0),
n as (select pair, comp, count(*) c from u group by 1, 2), b as (select pair, arg_max(comp, c * 1000 - comp) comp from n group by 1),
q as (select u.*, sum(corr) over (partition by pair order by phase, corr rows unbounded preceding) s, lead(phase) over (partition by pair order by phase, corr) nx, sum(corr) over (partition by pair) / 2 h from u join b using (pair, comp)),
k as (select *, abs(s - h) <= 1e-8 + 1e-5 * h and nx is not null e from q)
select pair, round(arg_min(case when e then (phase + nx) / 2 else phase end, s) filter (where s >= h or e), 6) "offset", any_value(comp) component, count(*) pixels, round(median(corr), 6) median_coherence from k group by 1""")
def reference_offsets(spark: SparkSession, folder: str) -> DataFrame:
    pixels = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_extendedprice").alias("phase"), F.col("l_discount").alias("corr"), F.col("l_linenumber").alias("comp"))
    return insar.reference_offsets(pixels).select("pair", r("offset"), "component", "pixels", r("median_coherence"))


@query("select l_suppkey, round(sqrt(sum(l_quantity * pow(l_discount - l_tax, 2)) / sum(l_quantity)), 8) rmse from lineitem group by 1")
def weighted_rmse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("residual", F.col("l_discount") - F.col("l_tax"))
    return insar.weighted_rmse(rows, "residual", "l_quantity", ["l_suppkey"]).select("l_suppkey", r("rmse", 8))


@query(f"with {_CELLS} select cell_id, round(regr_slope(los_mm, date_diff('day', date '1970-01-01', date)) * 365.25, 4) mm_per_year from c group by 1")
def velocity_slope(spark: SparkSession, folder: str) -> DataFrame:
    return insar.velocities(user_days(spark, folder), "los_mm", "date", ["cell_id"]).select("cell_id", r("mm_per_year", 4))


@query(f"""with {_CELLS} select date, 1::double valid_fraction, round(avg(los_mm), 6) mean, round(min(los_mm), 6) least, round(max(los_mm), 6) most from c group by 1""", dates=("date",))
def date_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = insar.date_statistics(user_days(spark, folder))
    return rows.select("date", r("valid_fraction"), r("mean"), r("least"), r("most"))


@query("""select l_suppkey pair, count(*) n_cells, sum((l_quantity > 10)::int)::bigint n_valid, round(avg((l_quantity > 10)::int), 6) valid_fraction, round(avg(l_discount) filter (where l_quantity > 10), 6) mean_coherence from lineitem group by 1""")
def pair_statistics(spark: SparkSession, folder: str) -> DataFrame:
    pixels = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("pair"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("phase"), F.col("l_discount").alias("corr"))
    return insar.pair_statistics(pixels).select("pair", "n_cells", "n_valid", r("valid_fraction"), r("mean_coherence"))


_DOT = "list_dot_product(embedding::double[], r::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(r::double[], r::double[])))"


@query(f"with q as (select label, arg_min(embedding, vec_id) r from embeddings group by 1) select vec_id, round(acos(least(greatest({_DOT}, -1), 1)), 5) angle from embeddings join q using (label)")
def spectral_angle(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    reference = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("_r"))  # one spectrum for each label
    return rows.join(reference, "label").select("vec_id", r(scores.spectral_angle(F.col("embedding"), F.col("_r")), 5).alias("angle"))


@query("""with b as (select event_id, value * 10 a, value * 20 b, value * 30 c, value * 5 d from events)
select event_id, round(pow(greatest((1 - a / 10000) * (1 - b / 10000) * (1 - c / 10000) * (1 - d / 10000), 0), 0.25), 8) shadow, round((a - b) / nullif(a + b, 0), 8) ratio from b""")
def pixel_indices(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", *[(F.col("value") * k).alias(n) for n, k in (("a", 10), ("b", 20), ("c", 30), ("d", 5))])
    bands = [F.col(c) for c in "abcd"]
    return rows.select("event_id", r(scores.shadow_index(bands), 8).alias("shadow"), r(scores.ratio_index(F.col("a"), F.col("b")), 8).alias("ratio"))


@query("""with u as (select vec_id, unnest([443, 490, 740, 783, 842, 865]) x, unnest(embedding[1:6])::double y from embeddings)
select vec_id, round(regr_slope(y, x), 8) slope, round(regr_intercept(y, x), 6) intercept from u group by 1""")
def band_regression(spark: SparkSession, folder: str) -> DataFrame:
    slope, intercept = scores.band_regression([F.col("embedding")[i].cast("double") for i in range(6)])
    return table(spark, folder, "embeddings").select("vec_id", r(slope, 8).alias("slope"), r(intercept).alias("intercept"))


_DATES = "a as (select ts::date date, avg(value) baseline from events group by 1)"
_PAIRS = f"{_DATES}, p as (select x.date ref, y.date rep, y.baseline - x.baseline baseline, date_diff('day', x.date, y.date) duration from a x join a y on x.date < y.date and date_diff('day', x.date, y.date) <= 3 and abs(y.baseline - x.baseline) <= 1.5)"


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("baseline"))


@query(f"with {_PAIRS} select ref, rep, round(baseline, 6) baseline, duration::int duration from p", dates=("ref", "rep",))
def date_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return network.date_pairs(_dates(spark, folder), 3, 1.5).select("ref", "rep", r("baseline"), "duration")


@query(f"with {_PAIRS} select date, count(*) degree from (select ref date from p union all select rep from p) group by 1", dates=("date",))
def date_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return network.degrees(network.date_pairs(_dates(spark, folder), 3, 1.5))


@query(f"""with recursive {_PAIRS}, e as (select ref a, rep b from p union all select rep, ref from p),
t(node, root) as (select date, date from a union select e.b, t.root from t join e on e.a = t.node)
select node, min(root) component from t group by 1""", dates=("node", "component",))
def date_components(spark: SparkSession, folder: str) -> DataFrame:
    dates = _dates(spark, folder)
    return network.components(dates.select(F.col("date").alias("node")), network.date_pairs(dates, 3, 1.5).select(F.col("ref").alias("a"), F.col("rep").alias("b")))


_GRID = f"""recursive {_DATES}, g(days, metres) as (values (2, 1.0), (2, 3.0), (4, 1.0), (4, 3.0)),
p as (select days, metres, x.date ref, y.date rep from g, a x join a y on x.date < y.date where date_diff('day', x.date, y.date) <= days and abs(y.baseline - x.baseline) <= metres),
e as (select days, metres, ref a, rep b from p union all select days, metres, rep, ref from p),
t(days, metres, node, root) as (select days, metres, date, date from g, a union select t.days, t.metres, e.b, t.root from t join e on e.days = t.days and e.metres = t.metres and e.a = t.node),
c as (select days, metres, node, min(root) root from t group by all),
n as (select days::int as days, metres::double metres, (select count(*) from p where p.days = c.days and p.metres = c.metres) n_pairs, count(distinct root) n_components from c group by c.days, c.metres)"""


@query(f"with {_GRID} select * from n")
def network_grid(spark: SparkSession, folder: str) -> DataFrame:
    return network.network_grid(_dates(spark, folder), [2, 4], [1.0, 3.0])


@query(f"with {_GRID} select * from n order by n_components, n_pairs, days, metres limit 1")
def best_network(spark: SparkSession, folder: str) -> DataFrame:
    return network.best_network(network.network_grid(_dates(spark, folder), [2, 4], [1.0, 3.0]))


@query("select c_custkey, dense_rank() over (order by f) site_id from (select c_custkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment) f from customer)")
def site_ids(spark: SparkSession, folder: str) -> DataFrame:
    return joins.site_ids(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_custkey", "site_id")


@query("select o_orderkey, c_mktsegment level, n_name subsystem from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def log_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", F.col("c_nationkey").alias("subsystem_id"))
    kinds = rows.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("level_id"), F.col("c_mktsegment").alias("level"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("subsystem_id"), F.col("n_name").alias("subsystem"))
    return audit.events_with_names(rows.withColumnRenamed("c_mktsegment", "level_id"), kinds, names).select("o_orderkey", "level", "subsystem")


_LEVEL = "case event_type when 'signup' then 'task_started' when 'purchase' then 'task_finished' when 'error' then 'task_failed' else 'info' end"


@query(f"""with l as (select event_id id, user_id task_id, ts, {_LEVEL} as level from events), t as (select * from l where level like 'task\\_%' escape '\\')
select task_id, arg_max(level[6:], (ts, id)) state, round((epoch_us(max(ts) filter (where level <> 'task_started')) - epoch_us(min(ts) filter (where level = 'task_started'))) / 1e6, 6) as seconds from t group by 1""")
def task_states(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("ts").alias("timestamp"), F.expr(_LEVEL).alias("level"))
    return audit.task_states(log).select("task_id", "state", r("seconds"))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 20")
def latest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return audit.latest(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 20, "o_orderkey")


@query("select distinct user_id from events where user_id not in (select c_custkey from customer)")
def unseen_keys(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "events").select("user_id").distinct()
    return joins.split_by_presence(left, table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])[1]


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def seen_keys(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "customer").select(F.col("c_custkey"))
    return joins.split_by_presence(left, table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])[0]


@query("""with f as (select file_id, regexp_extract(file_name, 'feed-(\\d+-\\d+)', 1) k from insitu_files), p as (select regexp_extract(feed, '(\\d+-\\d+)$', 1) k, min(feed) feed from insitu_files group by 1)
select file_id, feed from f left join p using (k)""")
def names_by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "insitu_files")
    return joins.lookup_by_pattern(files.select("file_id", "file_name"), files.select("feed"), F.regexp_extract("file_name", r"feed-(\d+-\d+)", 1), F.regexp_extract("feed", r"(\d+-\d+)$", 1), "feed").select("file_id", "feed")


@query("""select id, collection, asset.key as asset, asset.value.href as href, asset.value.type as type from (select id, collection, unnest(map_entries(assets)) asset from stac_items)""")
def flat_assets(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.flat_assets(table(spark, folder, "stac_items")).select("id", "collection", "asset", "href", "type")


@query("""with b as (select id, collection, properties.datetime dt, case when len(bbox) = 6 then [bbox[1], bbox[2], bbox[4], bbox[5]] when len(bbox) = 4 then bbox end b from stac_items)
select id, collection from b where b is not null and try_cast(dt as timestamptz) between '2024-01-01T00:00:00Z'::timestamptz and '2025-06-30T00:00:00Z'::timestamptz
and b[2] <= 60.5 and b[4] >= 59.5 and case when b[1] <= b[3] then b[1] <= 60 and b[3] >= -30 else b[1] <= 60 or b[3] >= -30 end""")
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.search(table(spark, folder, "stac_items"), bbox=(-30, 59.5, 60, 60.5), start="2024-01-01T00:00:00Z", end="2025-06-30T00:00:00Z").select("id", "collection")


@query("""select collection, count(*) n_items, round(avg(properties."eo:cloud_cover"), 6) mean_cloud, count(distinct try_cast(properties.datetime as timestamptz)::date) n_dates,
min(case when b[1] <= b[3] then b[1] when b[1] > b[3] then -180 end) west, min(b[2]) south, max(case when b[1] <= b[3] then b[3] when b[1] > b[3] then 180 end) east, max(b[4]) north
from (select *, case when len(bbox) = 6 then [bbox[1], bbox[2], bbox[4], bbox[5]] when len(bbox) = 4 then bbox end b from stac_items) group by 1""")
def collection_summary(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.collection_summary(table(spark, folder, "stac_items")).withColumn("mean_cloud", r("mean_cloud"))


@query("""with b as (select *, properties p, case when len(bbox) = 6 then [bbox[1], bbox[2], bbox[4], bbox[5]] when len(bbox) = 4 then bbox end b from stac_items)
select id, list_filter([case when id is null then 'no id' end, case when collection is null then 'no collection' end,
  case when collection is not null and collection not in (select distinct collection from stac_items where collection is not null and properties."proj:epsg" is not null) then 'unknown collection' end,
  case when p.datetime is null then 'no datetime' end, case when try_cast(p.start_datetime as timestamptz) >= try_cast(p.end_datetime as timestamptz) then 'empty interval' end,
  case when bbox is null or len(bbox) = 0 then 'no bbox' end, case when len(bbox) > 0 and len(bbox) not in (4, 6) then 'bbox of another length' end,
  case when b is not null and not coalesce(b[1] >= -180 and b[3] <= 180 and b[2] >= -90 and b[4] <= 90, false) then 'bbox outside the world' end], lambda x: x is not null)::varchar errors from b""")
def item_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stac_items")
    known = rows.filter("properties.`proj:epsg` is not null").select("collection")
    found = catalog.item_errors(rows, known)
    return found.select("id", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@query("""with n as (select s_suppkey, s_name || '*' s_name from supplier where s_nationkey < 5) select s_suppkey, s_name from n union all select s_suppkey, s_name from supplier where s_suppkey not in (select s_suppkey from n)""")
def catalog_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier")
    new = rows.filter("s_nationkey < 5").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"))
    return catalog.upsert(rows.select("s_suppkey", "s_name"), new, ["s_suppkey"])


@query("""select event_id message_id, event_id % 7 = 0 dead, case when event_id % 7 <> 0 then event_type end sensor_type, case when event_id % 7 <> 0 then round(value, 6) end pressure_kpa from events""")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages, every seventh cut off: what is parsed against what was written."""
    rows = table(spark, folder, "events")
    text = F.to_json(F.struct(F.col("event_id").alias("message_id"), F.col("event_type").alias("sensor_type"), F.col("value").alias("pressure_kpa")))
    raw = rows.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.col("event_id").cast("string"), text)).otherwise(text).alias("value"))
    found = messages.parsed(raw)
    number = F.coalesce("message_id", F.regexp_extract("value", r"^(\d+)", 1).try_cast("bigint"))
    return found.select(number.alias("message_id"), "dead", "sensor_type", r("pressure_kpa"))


@query("select event_id, round((value - avg(value) over w) / stddev_pop(value) over w, 6) value_z from events window w as (partition by event_type)")
def z_scores(spark: SparkSession, folder: str) -> DataFrame:
    return features.z_scored(table(spark, folder, "events"), "value", ["event_type"]).select("event_id", r("value_z"))


@query("select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) value_scaled from events")
def min_max(spark: SparkSession, folder: str) -> DataFrame:
    return features.scaled(table(spark, folder, "events"), "value").select("event_id", r("value_scaled"))


@query("select reading_id, def_x, round(coalesce(velocity, median(velocity) over (partition by platform)), 6) velocity from slope_readings")
def imputed_median(spark: SparkSession, folder: str) -> DataFrame:
    return features.imputed(table(spark, folder, "slope_readings"), "velocity", "median", ["platform"]).select("reading_id", "def_x", r("velocity"))


@query("with q as (select quantile_cont(def_x, 0.01) lo, quantile_cont(def_x, 0.99) hi from slope_readings) select reading_id, round(case when def_x is null then null else least(greatest(def_x, lo), hi) end, 6) + 0.0 def_x_clipped from slope_readings, q")
def clipped_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return features.clipped(table(spark, folder, "slope_readings"), "def_x").select("reading_id", r("def_x_clipped"))


@query("select event_id, (event_type = 'error')::int event_type_error, (event_type = 'view')::int event_type_view from events")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return features.one_hot(table(spark, folder, "events"), "event_type", ["error", "view"]).select("event_id", "event_type_error", "event_type_view")


@query("with c as (select event_type, (row_number() over (order by count(*) desc, event_type) - 1)::int code from events group by 1) select event_id, code from events join c using (event_type)")
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    return features.labelled(table(spark, folder, "events"), "event_type", "code").select("event_id", "code")


@query(f"with {_CELLS} select cell_id, list([los_mm] order by date) tensor from (select cell_id, date, round(los_mm, 4) los_mm from c) group by 1")
def pixel_tensor(spark: SparkSession, folder: str) -> DataFrame:
    rows = user_days(spark, folder).withColumn("los_mm", F.round("los_mm", 4))
    return features.tensor(rows, ["cell_id"], "date", ["los_mm"])


@query("""with g as (select user_id, value, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 86400000000 gap from events)
select user_id, round(coalesce(max(gap), 0), 6) longest_gap_days, coalesce(max(gap), 0) <= 2 "valid" from g group by 1""")
def series_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return features.gaps(table(spark, folder, "events"), ["user_id"], "ts", "value", longest_days=2.0).select("user_id", r("longest_gap_days"), "valid")


@query("""select case when pressure_kpa is null and (temperature_c is null or isnan(temperature_c)) then 'Warn' when coalesce(not (pressure_kpa between 0 and 10000), false)
or (temperature_c is not null and not isnan(temperature_c) and not (temperature_c between -5 and 50)) then 'Fail' else 'Pass' end status, count(*) n from sensor_messages group by 1""")
def message_status(spark: SparkSession, folder: str) -> DataFrame:
    return messages.checked(table(spark, folder, "sensor_messages")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select lower(trim(sensor_type)) sensor_type, cast(timestamp as timestamptz)::date as day, count(*) n from sensor_messages where timestamp is not null group by 1, 2", dates=("day",))
def message_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages.windowed(table(spark, folder, "sensor_messages"), length="1 day")
    return rows.select("sensor_type", F.to_date("start").alias("day"), "n")


@query("""with c as (select o_custkey, min(o_orderdate)::date s, max(o_orderdate)::date e from orders group by 1), m as (select *, unnest(generate_series(date_trunc('month', s)::timestamp, date_trunc('month', e)::timestamp, interval 1 month))::date mo from c)
select o_custkey, greatest(mo, s) slice_start, least(last_day(mo), e) slice_end from m""", dates=("slice_start", "slice_end",))
def month_slices(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return weather.month_slices(spans).select("o_custkey", "slice_start", "slice_end")


@query("select file_id, case when regexp_matches(lower(file_name), '\\.(csv|txt|xlsx?)$') then 'insitu' else 'asf' end kind from insitu_files")
def file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "insitu_files").select("file_id", scenes.kind_of(F.col("file_name")).alias("kind"))


def _kinds_sql() -> str:
    def case(text: str, kinds: dict[str, str]) -> str:
        return " ".join(f"when {' or '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words.split())} then '{kind}'" for kind, words in kinds.items())

    return f"""with h as (select file_id, lower(string_agg(name, ' ' order by ordinal)) names from (select distinct file_id, ordinal, name from table_columns) group by 1)
select file_id, case {case("lower(file_name)", detect.SENSOR_FILES)} {case("names", detect.SENSOR_HEADERS)} end sensor_type from insitu_files left join h using (file_id)"""


@query(_kinds_sql())
def file_sensor_types(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "table_columns").select("file_id", "ordinal", "name").distinct()
    heads = heads.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]).alias("names"))
    files = table(spark, folder, "insitu_files").join(heads, "file_id", "left")
    return files.select("file_id", detect.sensor_type(F.col("file_name"), F.col("names")).alias("sensor_type"))


@query("select distinct name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') normal from table_columns")
def normal_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "table_columns").select("name", normal_name(F.col("name")).alias("normal")).distinct()


@query("with w as (select max(length(qc::varchar)) > 1 wide from slope_readings) select reading_id, case when wide then (qc = 0)::int else coalesce(qc, 1) end qc from slope_readings, w")
def quality_flags(spark: SparkSession, folder: str) -> DataFrame:
    return text_files.with_quality(table(spark, folder, "slope_readings").select("reading_id", "qc"))


@query(f"""select platform, count(*) n_rows, min(measurement_date)::varchar "start", max(measurement_date)::varchar "end", min(location.lon) lon_min, min(location.lat) lat_min, max(location.lon) lon_max, max(location.lat) lat_max, 'EPSG:4326' epsg from {PH} group by 1""")
def dataset_extents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, PH).select("platform", F.col("measurement_date").cast("string").alias("iso_timestamp"), "location.lon", "location.lat")
    return text_files.dataset_metadata(rows, "platform")


@query("select ts::date date from events union select o_orderdate::date from orders", dates=("date",))
def union_of_dates(spark: SparkSession, folder: str) -> DataFrame:
    return joins.union_of_keys(table(spark, folder, "events").select(F.to_date("ts").alias("date")), table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")), ["date"])


@query("select event_id, user_id from (select *, row_number() over (partition by user_id, ts::date order by ts, event_id) n from events) where n = 1")
def first_of_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return quality.first_rows(rows, ["user_id", "day"], ["ts", "event_id"]).select("event_id", "user_id")


@query("select user_id, round(atan2(avg(sin(value)), avg(cos(value))), 6) angle from events group by 1")
def mean_phase(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(r(scores.phasor_angle(F.col("value"))).alias("angle"))


@query(f"select distinct platform, (floor((location.lon + 180) / 6) + 1)::int zone, (case when location.lat < 0 then 32700 else 32600 end + floor((location.lon + 180) / 6) + 1)::int epsg from {PH} where location.lon is not null and location.lat is not null")
def utm_zones(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = F.col("location.lon"), F.col("location.lat")
    return table(spark, folder, PH).filter("location.lon is not null and location.lat is not null").select("platform", scores.utm_zone(lon).alias("zone"), scores.utm_epsg(lat, lon).alias("epsg")).distinct()


@query()
def utm_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, PH).filter("location.lon is not null and location.lat is not null").select("location.lon", "location.lat").distinct()
    east, north = scores.utm_coordinates(F.col("lat"), F.col("lon"), scores.utm_zone(F.col("lon")))
    return rows.select("lon", "lat", r(east, 3).alias("east"), r(north, 3).alias("north"))


@query()
def solved_network(spark: SparkSession, folder: str) -> DataFrame:
    days = user_days(spark, folder).select(F.col("cell_id").alias("x"), "date", "los_mm")
    pairs = days.alias("a").join(days.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.datediff("b.date", "a.date") == 1))
    pixels = pairs.select(F.lit(0).alias("y"), F.col("a.x").alias("x"), F.col("a.date").alias("ref"), F.col("b.date").alias("rep"), (F.col("b.los_mm") - F.col("a.los_mm")).alias("phase"), F.lit(0.8).alias("corr"))
    return insar.solve_network(pixels, 1.0)


@query("""with recursive m as (select event_id // 100 y, event_id % 100 x from events where value > 60),
e as (select a.y ay, a.x ax, b.y by_, b.x bx from m a join m b on abs(a.y - b.y) + abs(a.x - b.x) = 1),
t(y, x, r) as (select y, x, y * 100 + x from m union select e.by_, e.bx, t.r from t join e on e.ay = t.y and e.ax = t.x),
c as (select y, x, min(r) r from t group by 1, 2), s as (select r, count(*) n from c group by 1 having count(*) >= 4), l as (select r, row_number() over (order by n desc, r)::int as label from s)
select y::int as "row", x::int col, label from c join l using (r)""")
def water_bodies(spark: SparkSession, folder: str) -> DataFrame:
    mask = table(spark, folder, "events").filter("value > 60").select(F.floor(F.col("event_id") / 100).cast("int").alias("row"), (F.col("event_id") % 100).cast("int").alias("col"))
    return raster.labelled(mask)


@query(f"""select distinct platform from {PH} where location.lat > 59.5 and location.lat - 59.5 < (location.lon + 60) * (1.5 / 60) and location.lat - 59.5 < (60 - location.lon) * (1.5 / 60)""")
def points_in_area(spark: SparkSession, folder: str) -> DataFrame:
    inside = geometry.in_polygon(F.col("location.lon"), F.col("location.lat"), [[(-60.0, 59.5), (60.0, 59.5), (0.0, 61.0)]])
    return table(spark, folder, PH).filter(inside).select("platform").distinct()


@query("""with g as (select event_id // 100 "row", event_id % 100 col, value from events), p as (select vec_id, 5 + 20 * abs(embedding[1])::double y, 5 + 20 * abs(embedding[2])::double x from embeddings)
select vec_id, case when count(g.value) = 4 then round(sum(g.value * (case when "row" = floor(y) then 1 - (y - floor(y)) else y - floor(y) end) * (case when col = floor(x) then 1 - (x - floor(x)) else x - floor(x) end)), 4) end "value"
from p left join g on "row" in (floor(y), floor(y) + 1) and col in (floor(x), floor(x) + 1) group by 1""")
def bilinear_samples(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "events").select(F.floor(F.col("event_id") / 100).alias("row"), (F.col("event_id") % 100).alias("col"), "value")
    points = table(spark, folder, "embeddings").select("vec_id", (5 + 20 * F.abs(F.col("embedding")[0]).cast("double")).alias("y"), (5 + 20 * F.abs(F.col("embedding")[1]).cast("double")).alias("x"))
    return raster.sampled(cells, points).select("vec_id", r("value", 4))


@query(f"""with r as (select o_orderkey::varchar task_id, o_orderdate::timestamp s, case when o_orderstatus <> 'P' then o_orderdate::timestamp + to_days((o_orderkey % 5)::int) end e, o_orderstatus = 'F' ok from orders)
select task_id, case when e is null then 'started' when ok then 'finished' else 'failed' end state, (epoch(e) - epoch(s))::double "seconds" from r""")
def audit_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs, written as log events and read back as states."""
    start = F.col("o_orderdate").cast("timestamp")
    ended = F.when(F.col("o_orderstatus") != "P", F.timestamp_micros(F.unix_micros(start) + (F.col("o_orderkey") % 5) * 86_400_000_000))
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), start.alias("started"), ended.alias("ended"), (F.col("o_orderstatus") == "F").alias("ok"))
    return audit.task_states(audit.task_events(runs)).select("task_id", "state", "seconds")


@query("""with k as (select platform, reading_id, count(*) c from slope_readings group by all), d as (select platform, sum(c - 1) duplicates from k group by 1),
f as (select platform, sum((qc = 0)::int) fault_rows, sum((qc is distinct from 0 and (depth is null or def_x is null or def_y is null or def_z is null or velocity is null))::int) missing_rows,
  sum((qc is distinct from 0 and not coalesce(def_x between -100 and 100, true))::int) range_rows from slope_readings group by 1),
s as (select platform dataset_id, case when duplicates > 0 or fault_rows > 0 or range_rows > 0 then 'Fail' when missing_rows > 0 then 'Warn' else 'Pass' end status,
  '[' || concat_ws(', ', case when duplicates > 0 then 'repeated keys' end, case when fault_rows > 0 then 'sensor faults' end, case when range_rows > 0 then 'values out of range' end, case when missing_rows > 0 then 'missing values' end) || ']' errors from f join d using (platform))
select 'in_situ' data_type, * from s
union all select 'eo_raster', item_no::varchar, case when max(properties."eo:cloud_cover") > 50 then 'Fail' else 'Pass' end, case when max(properties."eo:cloud_cover") > 50 then '[null pixels]' else '[]' end from stac_items group by item_no""")
def qc_routed(spark: SparkSession, folder: str) -> DataFrame:
    """Each type of data by its controller: results of all datasets."""
    readings = table(spark, folder, "slope_readings").select("reading_id", F.col("platform").alias("source"), "platform", "depth", "def_x", "def_y", "def_z", "velocity", "qc")
    cover = F.coalesce(F.col("properties.`eo:cloud_cover`") > 50, F.lit(False))
    items = table(spark, folder, "stac_items").select("item_no", F.when(cover, 1.0).otherwise(0.0).alias("null_pixel_pct"), F.lit(True).alias("is_geometrically_aligned"), F.lit("optical").alias("sensor_type"), F.lit(40.0).alias("snr"), F.array(*map(F.lit, quality.RASTER["required"])).alias("metadata_keys"))
    found = qc_service.route("in_situ")(readings, "source", key="reading_id", qc="qc", platform="platform", limits={"def_x": (-100.0, 100.0)}).withColumn("data_type", F.lit("in_situ"))
    found = found.unionByName(qc_service.route("eo_raster")(items, "item_no").withColumn("data_type", F.lit("eo_raster")))
    return found.select("data_type", "dataset_id", "status", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@query("select o_orderkey from orders where o_orderdate::date between '1994-03-01' and '1997-10-31' and o_orderdate::date not in ('1995-01-05', '1996-07-11') and month(o_orderdate) in (4, 5, 6, 7, 8, 9)")
def scenes_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Processing window, excluded dates and months, with orders as scenes."""
    scenes_ = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("datetime"))
    kept = selection.without_dates(selection.processing_window(scenes_, "1994-03-01", "1997-10-31"), ["1995-01-05", "1996-07-11"])
    return selection.in_months(kept, range(4, 10)).select("o_orderkey")


@query("select o_orderkey from orders where o_orderdate::timestamptz >= '1994-03-01T00:00:00Z'::timestamptz and o_orderdate::timestamptz <= '1995-03-01T12:00:00Z'::timestamptz")
def scenes_between(spark: SparkSession, folder: str) -> DataFrame:
    return selection.between(table(spark, folder, "orders"), "1994-03-01", "1995-03-01T12:00:00Z", when="o_orderdate").select("o_orderkey")


@query("with c as (select c_nationkey, c_mktsegment, count(*) n from customer group by all), m as (select c_nationkey, max(n) n from c group by 1) select c_nationkey, min(c_mktsegment) c_mktsegment from c join m using (c_nationkey, n) group by 1")
def most_frequent(spark: SparkSession, folder: str) -> DataFrame:
    return selection.most_frequent(table(spark, folder, "customer"), "c_mktsegment", ["c_nationkey"])


@query("with c as (select l_linenumber, count(*) n from lineitem group by 1), p as (select min(l_linenumber) p from c where n = (select max(n) from c)) select l_orderkey, l_linenumber from lineitem, p where l_linenumber = p")
def scenes_on_path(spark: SparkSession, folder: str) -> DataFrame:
    return selection.on_path(table(spark, folder, "lineitem"), column="l_linenumber").select("l_orderkey", "l_linenumber")


@query("select event_type subswath, count(*) n, min(ts) \"first\", max(ts) \"last\" from events group by 1")
def subswath_summary(spark: SparkSession, folder: str) -> DataFrame:
    return selection.subswath_summary(table(spark, folder, "events").withColumnRenamed("event_type", "subswath"), when="ts")


@query(f"""with {_CELLS}, a as (select *, (los_mm - lag(los_mm) over w) / nullif(date_diff('day', lag(date) over w, date), 0) rate, date_diff('day', lag(date) over w, date) as days from c window w as (partition by cell_id order by date))
select cell_id, date, round(rate, 6) rate, round((rate - lag(rate) over (partition by cell_id order by date)) / nullif(days, 0), 6) acceleration from a""", dates=("date",))
def accelerations(spark: SparkSession, folder: str) -> DataFrame:
    return series.accelerations(user_days(spark, folder), "los_mm", ["cell_id"], "date").select("cell_id", "date", r("rate"), r("acceleration"))


@query(f"""with {_PAIRS}, d as (select date, row_number() over (order by date) - 1 i from (select ref date from p union select rep from p))
select ref, rep, a.i ref_index, b.i rep_index from p join d a on a.date = ref join d b on b.date = rep""", dates=("ref", "rep"))
def pair_indices(spark: SparkSession, folder: str) -> DataFrame:
    return network.ordinals(network.date_pairs(_dates(spark, folder), 3, 1.5)).select("ref", "rep", "ref_index", "rep_index")


@query(f"select distinct platform, printf('%.6f_%.6f', location.lat, location.lon) cell from {PH} where location.lat is not null and location.lon is not null")
def cell_keys(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, PH).select("platform", scores.cell_key(F.col("location.lat"), F.col("location.lon"), 6).alias("cell"))
    return found.filter("cell is not null").distinct()


@query("select event_id, round(value * -4.4, 6) los from events")
def wrapped_to_mm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", r(scores.los_mm(F.col("value"), -4.4)).alias("los"))


@query("select vec_id, i - 1 place, round(embedding[i]::double, 6) \"value\" from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings)")
def long_rows(spark: SparkSession, folder: str) -> DataFrame:
    return insar.long_rows(table(spark, folder, "embeddings"), "embedding", ["vec_id"]).select("vec_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"""select platform, count(*) n_rows, coalesce(max(sensor), 'sensor') data_source, 'stream' format, 'streaming' mode, 'in_situ' as type, 'EPSG:4326' crs from (select platform, null::varchar sensor from sensor_messages where platform is not null) group by 1""")
def stream_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sensor_messages").filter("platform is not null").select("platform", F.col("timestamp").alias("iso_timestamp"))
    return ingestion.stream_metadata(rows, "platform").select(F.col("dataset_id").alias("platform"), "n_rows", "data_source", "format", "mode", "type", "crs")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) n, (c_custkey % 20)::bigint expected, (select count(*) from orders where o_custkey = c_custkey) = c_custkey % 20 ok from customer")
def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    expected = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 20).alias("expected"))
    return ingestion.count_checks(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), expected, "c_custkey")


@query("select l_orderkey, l_linenumber, min(l_returnflag) || '_B0' || l_linenumber || '.jp2' band_file from lineitem group by 1, 2")
def band_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each line's file in two folders: the finer one is taken."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit("_B0"), "l_linenumber", F.lit(".jp2")).alias("name"))
    paths = rows.withColumn("path", F.explode(F.array(F.concat(F.lit("/p/R20m/"), "name"), F.concat(F.lit("/p/R10m/"), "name"))))
    finest = paths.groupBy("l_orderkey", "l_linenumber").agg(F.min(selection.band_order(F.col("path"))).alias("f"))
    return finest.select("l_orderkey", "l_linenumber", F.regexp_extract("f.path", r"/R10m/([^/]*)$", 1).alias("band_file"))
