"""Relational completeness: joins, set operations, grouping sets, time windows, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.bars import table


@query("join_semi_anti", "select 'with' as side, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey) union all select 'without', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    side = lambda how, name: c.join(o, "c_custkey", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side("left_semi", "with").union(side("left_anti", "without"))


@query("join_inner_agg", "select r_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def join_inner_agg(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("set_ops", "select 'intersect' as op, count(*) as n from (select c_nationkey as k from customer intersect select s_nationkey from supplier) union all select 'except', count(*) from (select c_nationkey as k from customer except select s_nationkey from supplier) union all select 'union', count(*) from (select c_nationkey as k from customer union select s_nationkey from supplier)")
def set_ops(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    one = lambda df, name: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return one(c.intersect(s), "intersect").union(one(c.subtract(s), "except")).union(one(c.union(s).distinct(), "union"))


@query("cube_flags", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("rollup_flags", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("top_per_group", "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by value desc, event_id) <= 3")
def top_per_group(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("k", k).where("k <= 3").select("event_type", "event_id", "value")


@query("first_per_key", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def first_per_key(spark, sf_dir):
    """Drop duplicates with a defined winner: an aggregation with map-side combine, not a window."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", at).alias("event_id"))


@query("tumbling_window", "select event_type, time_bucket(interval '1 day', ts)::varchar as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query("sliding_window", "select (s)::varchar as start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by 1")
def sliding_window(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("session_window", "select user_id, count(distinct s) as sessions, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '6 hours', true)::int as new from events)) group by 1")
def session_window(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("udaf_upper_median", "select event_type, list_sort(list(value))[len(list(value)) // 2 + 1] as median from events group by 1")
def udaf_upper_median(spark, sf_dir):
    """The upper median as a distributed aggregate: the value at which the share passes one half. Counts by value are combined on
    the map side; no group is gathered as a list."""
    above = F.expr("percentile_disc(0.500000000001D) within group (order by value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(above.alias("median"))
