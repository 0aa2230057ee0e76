"""Calendar functions, daily means, windows, gap filling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoseries.functions import calendar as cal
from geoseries.functions.values import path_part
from geoseries.operators import series, splits
from geoseries.suite import bindings as b
from geoseries.suite.registry import query
from geoseries.suite.scans import FILLED_SQL

PARTS_SQL = """SELECT event_id, second(ts) / 59e0 - 0.5e0 AS second_of_minute, minute(ts) / 59e0 - 0.5e0 AS minute_of_hour,
    hour(ts) / 23e0 - 0.5e0 AS hour_of_day, (isodow(ts) - 1) / 6e0 - 0.5e0 AS day_of_week, (day(ts) - 1) / 30e0 - 0.5e0 AS day_of_month,
    (dayofyear(ts) - 1) / 365e0 - 0.5e0 AS day_of_year, (month(ts) - 1) / 11e0 - 0.5e0 AS month_of_year,
    (weekofyear(ts) - 1) / 52e0 - 0.5e0 AS week_of_year FROM events"""


@query("f01_f08_time_features", PARTS_SQL, floats=" ".join(cal.FEATURES))
def time_feature_columns(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", "ts")
    return events.select("event_id", *[f(F.col("ts")).alias(n) for n, f in cal.FEATURES.items()])


@query("f09_features_by_frequency", """SELECT l_suppkey, l_shipdate, (month(l_shipdate) - 1) / 11e0 - 0.5e0 AS month_of_year,
    (day(l_shipdate) - 1) / 30e0 - 0.5e0 AS day_of_month, (dayofyear(l_shipdate) - 1) / 365e0 - 0.5e0 AS day_of_year
    FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem)""", floats="month_of_year day_of_month day_of_year")
def features_by_frequency(spark, sf):
    days = b.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate").distinct()
    return cal.time_features(days, "l_shipdate", "D")


PART_SQL = {
    "second_of_minute": "floor(second(ts)) / 59e0 - 0.5e0", "minute_of_hour": "minute(ts) / 59e0 - 0.5e0", "hour_of_day": "hour(ts) / 23e0 - 0.5e0",
    "day_of_week": "(isodow(ts) - 1) / 6e0 - 0.5e0", "day_of_month": "(day(ts) - 1) / 30e0 - 0.5e0", "day_of_year": "(dayofyear(ts) - 1) / 365e0 - 0.5e0",
    "month_of_year": "(month(ts) - 1) / 11e0 - 0.5e0", "week_of_year": "(week(ts) - 1) / 52e0 - 0.5e0",
}
FREQUENCIES = list(cal.FREQUENCY_FEATURES)


@query("f09_all_frequencies", "SELECT event_id, " + ", ".join(
    f"{PART_SQL[name]} AS {freq}_{name}" for freq in FREQUENCIES for name in cal.FREQUENCY_FEATURES[freq]) + " FROM events",
       floats=" ".join(f"{freq}_{name}" for freq in FREQUENCIES for name in cal.FREQUENCY_FEATURES[freq]))
def all_frequencies(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "ts")
    for freq in FREQUENCIES:
        added = cal.frequency_features(freq)
        rows = cal.time_features(rows, "ts", freq).withColumnsRenamed({name: f"{freq}_{name}" for name in added})
    return rows.drop("ts")


@query("f10_f11_month_indicators", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt, month(l_shipdate) AS month, "
       + ", ".join(f"CAST(month(l_shipdate) = {m} AS INT) AS month_{m}" for m in range(1, 13)) + " FROM lineitem",
       ints="month " + " ".join(f"month_{m}" for m in range(1, 13)), dates="dt")
def month_columns(spark, sf):
    days = b.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("dt")).distinct()
    return days.withColumn("month", F.month("dt")).withColumns(cal.month_indicators(F.col("dt")))


@query("f12_land_cover_indicators", "SELECT p_partkey, " + ", ".join(f"CAST(p_size = {c} AS INT) AS cover_{c}" for c in range(1, 25))
       + ", CAST(p_size IS NULL AS INT) AS cover_nan FROM part",
       ints=" ".join(f"cover_{c}" for c in range(1, 25)) + " cover_nan")
def land_cover(spark, sf):
    part = b.table(spark, sf, "part")
    return part.select("p_partkey", *[
        c.alias(n) for n, c in cal.category_indicators(F.col("p_size"), range(1, 25), "cover", with_null=True).items()
    ])


@query("f13_year_doy_date", """SELECT DISTINCT year(l_shipdate) AS y, dayofyear(l_shipdate) AS doy, CAST(l_shipdate AS DATE) AS dt
    FROM lineitem""", ints="y doy", dates="dt")
def year_doy(spark, sf):
    days = b.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), F.dayofyear("l_shipdate").alias("doy")).distinct()
    return days.withColumn("dt", cal.year_doy_date(F.col("y"), F.col("doy")))


@query("f14_shift_day", """SELECT lat_i, lon_i, time - 1 AS time, tp FROM grid_daily""", floats="tp", dates="time")
def shift_day(spark, sf):
    return b.grid_daily(spark, sf).select("lat_i", "lon_i", cal.previous_day(F.col("time")).alias("time"), "tp")


@query("f15_month_calendar", """, m AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem)
    SELECT strftime(m, '%Y_%m') AS label, CAST(m + INTERVAL 1 MONTH AS DATE) AS next_month,
    CAST(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS dt FROM m""", dates="next_month dt")
def month_calendar(spark, sf):
    months = b.table(spark, sf, "lineitem").select(cal.month_start(F.col("l_shipdate")).alias("m")).distinct()
    return months.select(
        cal.year_month_label(F.col("m")).alias("label"), cal.next_month_start(F.col("m")).alias("next_month"),
        F.explode(cal.month_days(F.col("m"))).alias("dt"),
    )


@query("s02_path_part", "SELECT p_partkey, split_part(p_name, ' ', -1) AS tail, split_part(p_name, ' ', 1) AS head FROM part")
def path_parts(spark, sf):
    part = b.table(spark, sf, "part")
    return part.select(
        "p_partkey", path_part(F.col("p_name"), -1, " ").alias("tail"), path_part(F.col("p_name"), 1, " ").alias("head")
    )


@query("a01_daily_mean", "SELECT * FROM station_daily", floats="soil_moisture", dates="date_time")
def daily_mean(spark, sf):
    return b.station_daily(spark, sf)


@query("a02_daily_mean_right_closed", """SELECT station_id, CAST(ts - INTERVAL 1 MICROSECOND AS DATE) AS date_time,
    avg(soil_moisture) AS soil_moisture FROM station_raw GROUP BY ALL""", floats="soil_moisture", dates="date_time")
def daily_mean_right(spark, sf):
    return series.resample_daily(b.station_raw(spark, sf), ["station_id"], "ts", ["soil_moisture"], closed="right")


@query("w01_rolling_sum", """SELECT station_id, date_time, CASE WHEN count(*) OVER w7 = 7 THEN sum(soil_moisture) OVER w7 END AS sum7,
    CASE WHEN count(*) OVER w28 = 28 THEN sum(soil_moisture) OVER w28 END AS sum28 FROM station_daily
    WINDOW w7 AS (PARTITION BY station_id ORDER BY date_time RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
    w28 AS (PARTITION BY station_id ORDER BY date_time RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)""",
       floats="sum7 sum28", digits=5, dates="date_time")
def rolling(spark, sf):
    daily = b.station_daily(spark, sf)
    week = series.rolling_sum(daily, ["station_id"], "date_time", "soil_moisture", 7, "sum7")
    return series.rolling_sum(week, ["station_id"], "date_time", "soil_moisture", 28, "sum28").drop("soil_moisture")


@query("w02_verify_rolling", """, s AS (SELECT station_id, date_time, soil_moisture, sum(soil_moisture) OVER w7 AS stored,
    CASE WHEN count(*) OVER w7 = 7 THEN sum(soil_moisture) OVER w7 END AS recomputed FROM station_daily
    WINDOW w7 AS (PARTITION BY station_id ORDER BY date_time RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
    SELECT station_id, date_time, recomputed, CASE WHEN recomputed IS NULL THEN 'not full' WHEN
    abs(recomputed - (stored + CASE WHEN day(date_time) = 15 THEN 1 ELSE 0 END)) < 0.5e0 THEN 'ok' ELSE 'wrong' END AS verdict FROM s""",
       floats="recomputed", digits=5, dates="date_time")
def verify(spark, sf):
    from pyspark.sql import Window

    daily = b.station_daily(spark, sf)
    w = Window.partitionBy("station_id").orderBy(cal.day_number(F.col("date_time"))).rangeBetween(-6, 0)
    error = F.when(F.dayofmonth("date_time") == 15, 1).otherwise(0)
    stored = daily.select("station_id", "date_time", (F.sum("soil_moisture").over(w) + error).alias("stored"))
    checked = series.verify_rolling(daily, stored, ["station_id"], "date_time", "soil_moisture", "stored", 7)
    verdict = F.when(F.col("ok").isNull(), "not full").when(F.col("ok"), "ok").otherwise("wrong")
    return checked.select("station_id", "date_time", "recomputed", verdict.alias("verdict"))


@query("w03_temporal_split", """, r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY station_id) AS n FROM station_raw)
    SELECT event_id, station_id, CASE WHEN rn <= floor(n * (1 - 0.2e0)) THEN 'train' ELSE 'test' END AS status FROM r""")
def temporal(spark, sf):
    split = splits.temporal_split(b.station_raw(spark, sf), "station_id", "ts", ["event_id"])
    return split.select("event_id", "station_id", "status")


@query("w04_temporal_split3", """, r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY station_id) AS n FROM station_raw)
    SELECT event_id, station_id, CASE WHEN rn <= floor(n * (1 - (0.2e0 + 0.1e0))) THEN 'train'
    WHEN rn <= floor(n * (1 - (0.2e0 + 0.1e0))) + floor(n * 0.1e0) THEN 'val' ELSE 'test' END AS status FROM r""")
def temporal3(spark, sf):
    split = splits.temporal_split3(b.station_raw(spark, sf), "station_id", "ts", ["event_id"])
    return split.select("event_id", "station_id", "status")


SPATIAL_SQL = """, st AS (SELECT DISTINCT station_id FROM station_raw),
    rk AS (SELECT station_id, row_number() OVER (ORDER BY md5(concat('42:', station_id))) AS rn, count(*) OVER () AS n FROM st),
    sp AS (SELECT station_id, CASE WHEN rn <= ceil(n * 0.2e0) THEN 'test' ELSE 'train' END AS status FROM rk)"""


@query("w05_station_index", SPATIAL_SQL + """, ix AS (SELECT station_id, status,
    row_number() OVER (ORDER BY status DESC, station_id) - 1 AS station_idx FROM sp)
    SELECT station_idx, station_id, status, count(*) AS n FROM station_raw JOIN ix USING (station_id) GROUP BY ALL""")
def index(spark, sf):
    split = splits.spatial_split(b.station_raw(spark, sf), "station_id", 42)
    indexed = splits.station_index(split, "station_id")
    return indexed.groupBy("station_idx", "station_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("w06_first_per_station", """SELECT station_id, ts, event_id, soil_moisture FROM (SELECT *, row_number() OVER
    (PARTITION BY station_id ORDER BY ts, event_id) AS rn FROM station_raw) WHERE rn = 1""", floats="soil_moisture")
def first(spark, sf):
    return splits.first_per_station(b.station_raw(spark, sf), "station_id", ["ts", "event_id"], ["soil_moisture"])


@query("w07_match_moments", """, s AS (SELECT station_idx, avg("true") AS m, stddev_samp("true") AS s, avg(pred_a) AS tm,
    stddev_samp(pred_a) AS ts FROM scores_wide GROUP BY ALL)
    SELECT station_idx, date_time, l_orderkey, l_linenumber, l_partkey, "true" AS true_origin,
    ("true" - m) / nullif(s, 0) * ts + tm AS "true" FROM scores_wide JOIN s USING (station_idx)""", floats="true true_origin", dates="date_time")
def moments(spark, sf):
    matched = splits.match_moments(b.scores_wide(spark, sf), ["station_idx"], "true", "pred_a")
    return matched.select("station_idx", "date_time", "l_orderkey", "l_linenumber", "l_partkey", "true_origin", "true")


@query("w08_fill_days", FILLED_SQL, floats="soil_moisture", ints="Is_valid", dates="date_time")
def fill(spark, sf):
    return series.fill_days(b.station_daily(spark, sf), ["station_id"], "date_time", ["soil_moisture"])


INTERPOLATED_SQL = """, nb AS (SELECT *, {prev} AS p, {nxt} AS q, last_value(v IGNORE NULLS) OVER wb AS pv, first_value(v IGNORE NULLS) OVER wa AS qv
    FROM filled WINDOW wb AS (PARTITION BY station_id ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    wa AS (PARTITION BY station_id ORDER BY date_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT station_id, date_time, CASE WHEN v IS NOT NULL THEN v WHEN qv IS NULL THEN pv
    ELSE pv + (qv - pv) * (date_time - p) / nullif(q - p, 0) END AS {name}, {valid} FROM nb""".replace(
    "{prev}", "last_value(CASE WHEN v IS NOT NULL THEN date_time END IGNORE NULLS) OVER wb"
).replace("{nxt}", "first_value(CASE WHEN v IS NOT NULL THEN date_time END IGNORE NULLS) OVER wa")


@query("w09_interpolate", """, span AS (SELECT station_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM station_raw GROUP BY ALL),
    days AS (SELECT station_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date_time FROM span),
    filled AS (SELECT d.station_id, d.date_time, s.soil_moisture AS v FROM days d LEFT JOIN station_daily s USING (station_id, date_time))"""
       + INTERPOLATED_SQL.replace("{name}", "soil_moisture").replace("{valid}", "CAST(v IS NOT NULL AS INT) AS Is_valid"),
       floats="soil_moisture", ints="Is_valid", dates="date_time")
def interpolate(spark, sf):
    # bad samples leave days without a value at the start, inside and at the end of a series
    masked = b.station_raw(spark, sf).withColumn(
        "soil_moisture", F.when(F.col("soil_moisture_flag") == "G", F.col("soil_moisture"))
    )
    daily = series.resample_daily(masked, ["station_id"], "ts", ["soil_moisture"], drop_empty=False)
    filled = series.fill_days(daily, ["station_id"], "date_time", ["soil_moisture"])
    return series.interpolate_linear(filled, ["station_id"], cal.day_number(F.col("date_time")), ["soil_moisture"], chunk=10)


@query("w10_upsample_daily", """, span AS (SELECT station_id, min(date_time) AS a, max(date_time) AS z FROM composites GROUP BY ALL),
    days AS (SELECT station_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date_time FROM span),
    filled AS (SELECT d.station_id, d.date_time, s.lai AS v FROM days d LEFT JOIN composites s USING (station_id, date_time))"""
       + INTERPOLATED_SQL.replace("{name}", "lai").replace("{valid}", "CAST(v IS NOT NULL AS INT) AS Is_valid"),
       floats="lai", ints="Is_valid", dates="date_time")
def upsample(spark, sf):
    return series.upsample_daily(b.composites(spark, sf), ["station_id"], "date_time", ["lai"])


@query("w11_sequence_windows", """, r AS (SELECT station_id, date_time, soil_moisture, row_number() OVER (PARTITION BY station_id ORDER BY date_time) AS start
    FROM station_daily)
    SELECT a.station_id, a.start, c.start - a.start AS pos, c.date_time, c.soil_moisture FROM r a JOIN r c ON a.station_id = c.station_id
    AND c.start BETWEEN a.start AND a.start + 4 WHERE EXISTS (SELECT 1 FROM r z WHERE z.station_id = a.station_id AND z.start = a.start + 4)""",
       floats="soil_moisture", ints="pos", dates="date_time")
def windows(spark, sf):
    from geoseries.operators.ranking import chunked_rank, time_chunk

    ranked = chunked_rank(b.station_daily(spark, sf), ["station_id"], ["date_time"], time_chunk(F.col("date_time"), 366), "rn")
    built = series.sequence_windows(ranked, ["station_id"], F.col("rn"), ["date_time", "soil_moisture"], 5)
    return built.select("station_id", "start", F.posexplode("steps").alias("pos", "_s")).select(
        "station_id", "start", "pos", "_s.date_time", "_s.soil_moisture"
    )


@query("w12_dedup_groups", """, s AS (SELECT e.user_id AS station_id, e.user_id // 3 AS group_id,
    CASE WHEN e.user_id % 2 = 0 THEN 'first' ELSE 'second' END AS source, count(*) FILTER (event_type = 'click' AND value > 5) AS n_rows
    FROM events e GROUP BY ALL)
    SELECT source, group_id, min(station_id) AS station_id FROM s WHERE source = 'second' OR n_rows > 0 GROUP BY ALL""")
def dedup(spark, sf):
    events = b.table(spark, sf, "events")
    usable = F.when((F.col("event_type") == "click") & (F.col("value") > 5), 1)
    stations = events.groupBy(F.col("user_id").alias("station_id")).agg(F.count(usable).alias("n_rows")).select(
        "station_id", F.floor(F.col("station_id") / 3).alias("group_id"),
        F.when(F.col("station_id") % 2 == 0, "first").otherwise("second").alias("source"), "n_rows",
    )
    return splits.dedup_groups(stations, "group_id", "station_id", "source", "n_rows", ["first"])


@query("m01_spatial_split", SPATIAL_SQL + " SELECT station_id, status, count(*) AS n FROM station_raw JOIN sp USING (station_id) GROUP BY ALL")
def spatial(spark, sf):
    split = splits.spatial_split(b.station_raw(spark, sf), "station_id", 42)
    return split.groupBy("station_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("m02_spatial_split3", SPATIAL_SQL + """, rv AS (SELECT station_id, row_number() OVER (ORDER BY md5(concat('42:val:', station_id))) AS rn,
    count(*) OVER () AS n FROM sp WHERE status = 'train'), v AS (SELECT station_id FROM rv WHERE rn <= ceil(n * 0.125e0))
    SELECT station_id, CASE WHEN station_id IN (SELECT station_id FROM v) THEN 'val' ELSE status END AS status, count(*) AS n
    FROM station_raw JOIN sp USING (station_id) GROUP BY ALL""")
def spatial3(spark, sf):
    split = splits.spatial_split3(b.station_raw(spark, sf), "station_id", 42)
    return split.groupBy("station_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("m03_split_by_source", """, st AS (SELECT DISTINCT station_id, CASE WHEN station_id % 3 = 0 THEN 'first' ELSE 'second' END AS source
    FROM station_raw), rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    md5(concat(CASE source WHEN 'first' THEN '2390' ELSE '7' END, ':', source, ':', station_id))) AS rn, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (ORDER BY md5(concat('7:', source, ':', station_id))) AS all_rn, count(*) OVER () AS all_n FROM st),
    ly AS (SELECT unnest(['layer1', 'layer2', 'layer4']) AS layer)
    SELECT layer, station_id, source, CASE WHEN (layer = 'layer4' AND all_rn <= ceil(all_n * 0.2e0)) OR (layer <> 'layer4' AND rn <= ceil(n * 0.2e0))
    THEN 'test' ELSE 'train' END AS status FROM rk, ly WHERE layer <> 'layer1' OR source = 'first'""")
def by_source(spark, sf):
    raw = b.station_raw(spark, sf).withColumn("source", F.when(F.col("station_id") % 3 == 0, "first").otherwise("second"))
    parts = []
    for layer in ("layer1", "layer2", "layer4"):  # one of each rule
        split = splits.spatial_split_by_source(raw, "station_id", "source", {"first": 2390, "second": 7}, layer)
        parts.append(split.select(F.lit(layer).alias("layer"), "station_id", "source", "status").distinct())
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m07_stratified_folds", """, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag = 'A' ORDER BY
    md5(concat_ws(':', '7', l_orderkey, l_linenumber, l_partkey, l_suppkey, dt)), l_quantity) AS rn FROM li_cell)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt AS "day", CAST(l_returnflag = 'A' AS INT) AS label, (rn - 1) % 5 AS fold FROM r""",
       ints="label fold", dates="day")
def folds(spark, sf):
    li = b.table(spark, sf, "lineitem").withColumns({
        "day": F.to_date("l_shipdate"), "label": (F.col("l_returnflag") == "A").cast("int"),
    })
    folded = splits.stratified_folds(li.select(*b.KEYS, "label", "l_quantity"), "label", b.KEYS, 5, 7, ties=["l_quantity"])
    return folded.select(*b.KEYS, "label", "fold")
