"""Cleaning, alignment and calendar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import by, r6
from ..plans.registry import query
from ..sources.bars import bars, table


# ------------------------------------------------------------------------------------------------- parsing
def parse_date(c):
    """The first of three formats that fits."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")])


def parse_number(c):
    return F.regexp_replace(c, ",", "").try_cast("double")


RAW_DATE = "case when o_orderkey % 4 = 0 then {iso} when o_orderkey % 4 = 1 then replace({iso}, '-', '/') when o_orderkey % 4 = 2 then replace({iso}, '-', '') else concat('on ', {iso}) end"


@query("parse_dates", "select o_orderkey, case when o_orderkey % 4 = 3 then null else cast(cast(o_orderdate as date) as varchar) end as date from orders")
def parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(RAW_DATE.format(iso="cast(cast(o_orderdate as date) as string)")).alias("raw"))
    return o.select("o_orderkey", parse_date(F.col("raw")).cast("string").alias("date"))


@query("parse_numbers", "select o_orderkey, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 2) end as price from orders")
def parse_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", parse_number(raw).alias("price"))


@query("price_formats", "select o_orderkey, case when o_orderkey % 6 = 0 then '0.00' else printf('%.2f', o_totalprice) end as price, case when o_orderkey % 6 = 0 then '0' else cast(cast(trunc(o_totalprice) as bigint) as varchar) end as volume from orders")
def price_formats(spark, sf_dir):
    """Prices with two places and whole volumes as text; what is missing (here every sixth) is 0.00 and 0."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("v"))
    return x.select("o_orderkey", F.coalesce(F.format_string("%.2f", F.coalesce("v", F.lit(0.0)))).alias("price"), F.coalesce(F.col("v").cast("long"), F.lit(0)).cast("string").alias("volume"))


# -------------------------------------------------------------------------------------------------- cleaning
@query("gap_fill", """, wd as (select symbol, date, close from bars where dayofweek(date) between 1 and 5 and (dayofmonth(date) * 7 + ascii(symbol)) % 5 <> 0),
  rng as (select symbol, unnest(generate_series(min(date), max(date), interval 1 day))::date as date from wd group by symbol),
  need as (select r.symbol, r.date from rng r where dayofweek(r.date) between 1 and 5 and not exists (select 1 from wd where wd.symbol = r.symbol and wd.date = r.date)),
  fill as (select n.symbol, n.date, w.close, w.symbol as origin, row_number() over (partition by n.symbol, n.date order by w.symbol) as k from need n join wd w on w.date = n.date and w.symbol <> n.symbol)
  select symbol, date::varchar as date, close, origin from fill where k = 1 union all select symbol, date::varchar, close, symbol from wd""", bars=True)
def gap_fill(spark, sf_dir):
    """Business days that a symbol misses, filled from the first other source that has them; never interpolated."""
    wd = bars(spark, sf_dir).where("weekday(date) < 5 and (dayofmonth(date) * 7 + ascii(symbol)) % 5 <> 0").select("symbol", "date", "close")
    return fill_missing_days(wd).withColumn("date", F.col("date").cast("string"))


def fill_missing_days(wd: DataFrame) -> DataFrame:
    days = wd.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    need = days.select("symbol", F.explode(F.sequence("a", "b")).alias("date")).where("weekday(date) < 5").join(wd, ["symbol", "date"], "left_anti")
    other = wd.withColumnRenamed("symbol", "origin")
    k = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("origin"))
    fill = need.join(other, "date").where("origin <> symbol").withColumn("k", k).where("k = 1")
    return fill.select("symbol", "date", "close", "origin").unionByName(wd.withColumn("origin", F.col("symbol")))


@query("volume_repair", """, raw as (select *, case when i % 97 = 50 then volume * 100 else volume end as v from bars),
  m as (select *, median(v) over w as m, count(v) over w as n from raw window w as (partition by symbol order by i rows between 59 preceding and current row))
  select symbol, i, case when n >= 10 and m > 0 and (v / m > 5 or v / m < 0.2) then m else v end as volume from m""", bars=True)
def volume_repair(spark, sf_dir):
    raw = bars(spark, sf_dir).withColumn("v", F.when(F.col("i") % 97 == 50, F.col("volume") * 100).otherwise(F.col("volume")))
    return repair_volume(raw, "v").select("symbol", "i", F.col("v").alias("volume"))


def repair_volume(b: DataFrame, c: str) -> DataFrame:
    """Volumes beyond 5 times or below a fifth of the median of 60 bars (10 at least) become that median."""
    b = b.withColumn("_s", F.array_sort(F.collect_list(c).over(by().rowsBetween(-59, 0)))).withColumn("_n", F.size("_s"))
    m = F.expr("(element_at(_s, cast((_n + 1) div 2 as int)) + element_at(_s, cast(_n div 2 + 1 as int))) / 2")
    ratio = F.col(c) / m
    return b.withColumn(c, F.when((F.col("_n") >= 10) & (m > 0) & ((ratio > 5) | (ratio < 0.2)), m).otherwise(F.col(c))).drop("_s", "_n")


def common_base(b: DataFrame, default: str = "1992-01-01") -> DataFrame:
    """The first date from `default` on that all symbols with at least 21 bars share, or the default."""
    fit = b.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 21").select("symbol")
    n = fit.agg(F.count("*").alias("n"))
    shared = b.join(fit, "symbol").where(F.col("date") >= F.lit(default).cast("date")).groupBy("date").agg(F.countDistinct("symbol").alias("m")).crossJoin(n).where("m = n")
    return shared.agg(F.coalesce(F.min("date"), F.lit(default).cast("date")).alias("base"))


BASE = ", fit as (select symbol from bars group by 1 having count(*) >= 21), cb as (select coalesce(min(date), date '1992-01-01') as base from (select date from bars join fit using (symbol) where date >= date '1992-01-01' group by 1 having count(distinct symbol) = (select count(*) from fit)))"


@query("common_base", f"{BASE} select base::varchar as base from cb", bars=True)
def common_base_query(spark, sf_dir):
    return common_base(bars(spark, sf_dir)).select(F.col("base").cast("string").alias("base"))


@query("rebase_100", f"{BASE}, f as (select symbol, arg_min(close, date) as b from bars, cb where date >= base group by 1) select symbol, date::varchar as date, round(close / b * 100, 2) as v from bars join f using (symbol), cb where date >= base", bars=True)
def rebase_100(spark, sf_dir):
    b = bars(spark, sf_dir)
    b = b.crossJoin(common_base(b)).where("date >= base")  # one row
    first = b.groupBy("symbol").agg(F.min_by("close", "date").alias("b"))
    return b.join(first, "symbol").select("symbol", F.col("date").cast("string").alias("date"), F.round(F.col("close") / F.col("b") * 100, 2).alias("v"))


@query("aligned_dates", ", c as (select date from bars group by 1 having count(distinct symbol) = (select count(distinct symbol) from bars)), f as (select symbol, arg_min(close, date) as b from bars join c using (date) group by 1) select date::varchar as date, symbol, round(close / b * 100, 2) as v from bars join c using (date) join f using (symbol)", bars=True)
def aligned_dates(spark, sf_dir):
    """Dates that all symbols have, each symbol rebased to 100 at the first of them."""
    b = bars(spark, sf_dir)
    n = b.agg(F.countDistinct("symbol").alias("n"))
    common = b.groupBy("date").agg(F.countDistinct("symbol").alias("m")).crossJoin(n).where("m = n").select("date")
    b = b.join(common, "date")
    first = b.groupBy("symbol").agg(F.min_by("close", "date").alias("b"))
    return b.join(first, "symbol").select(F.col("date").cast("string").alias("date"), "symbol", F.round(F.col("close") / F.col("b") * 100, 2).alias("v"))


# -------------------------------------------------------------------------------------------------- as-of joins
def asof_forward(left: DataFrame, right: DataFrame, at: str, date: str, value: str) -> DataFrame:
    """Adds to left the value of the first right row (same symbol) with date >= at, else of the last one.

    A union sorted once per symbol, not a range join."""
    cols = left.columns
    both = left.withColumns({"_d": F.col(at), "_v": F.lit(None).cast(dict(right.dtypes)[value]), "_k": F.lit(1)}).select(*cols, "_d", "_v", "_k").unionByName(right.select("symbol", F.col(date).alias("_d"), F.col(value).alias("_v"), F.lit(2).alias("_k")), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_d", "_k")
    nxt = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, 2**31 - 1))
    end = F.last("_v", ignorenulls=True).over(w.rowsBetween(-(2**31) + 1, 2**31 - 1))
    return both.withColumn(value, F.coalesce(nxt, end)).where("_k = 1").select(*cols, value)


@query("asof_forward", """, q as (select distinct l_returnflag as symbol, cast(o_orderdate as date) as day from lineitem join orders on o_orderkey = l_orderkey), e as (select symbol, max(i) as n from bars group by 1)
  select q.symbol, q.day::varchar as "at", coalesce(b.i, e.n) as i from q join e using (symbol) asof left join bars b on b.symbol = q.symbol and q.day <= b.date""", bars=True)
def asof_forward_query(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("o_orderkey = l_orderkey"))
    q = q.select(F.col("l_returnflag").alias("symbol"), F.col("o_orderdate").cast("date").alias("at")).distinct()
    return asof_forward(q, bars(spark, sf_dir), "at", "date", "i").withColumn("at", F.col("at").cast("string"))


# ------------------------------------------------------------------------------------------------- calendar
def business_days(a, b):
    """Weekdays after a up to b (dates, a <= b), in closed form."""
    upto = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))  # noqa: E731  days since a Monday
    count = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))  # noqa: E731  weekdays up to that day
    return (count(upto(b)) - count(upto(a))).cast("int")


@query("business_day_distance", "select o_orderkey, (select count(*) from generate_series(1, 40) t(k) where k <= o_orderkey % 40 and dayofweek(cast(o_orderdate as date) + k::int) between 1 and 5)::int as bdays from orders")
def business_day_distance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    return o.select("o_orderkey", business_days(F.col("a"), F.date_add("a", (F.col("o_orderkey") % 40).cast("int"))).alias("bdays"))


#: Holidays (ranges) and make-up working days of the example calendar; in production, parameters.
HOLIDAYS = [("1998-01-26", "1998-02-04"), ("1998-05-01", "1998-05-03"), ("1998-10-01", "1998-10-07")]
MAKE_UP = ["1998-01-24", "1998-09-26"]
_RANGES = " or ".join(f"d between date '{a}' and date '{b}'" for a, b in HOLIDAYS)
TRADING = f"d in ({', '.join(f"date '{x}'" for x in MAKE_UP)}) or (WD and not ({_RANGES}))"


#: What the calendar covers (days beyond it have no answer); make-up days and holidays are given for 1998, other years have weekends.
FIRST_DAY, LAST_DAY = "1990-01-01", "2010-12-31"


def calendar(spark: SparkSession, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    """d, trading, session (trading days up to and including d), snapped (the first trading day from d on): a dimension bounded
    by the years it covers."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as d")
    days = days.withColumn("trading", F.expr(TRADING.replace("WD", "weekday(d) < 5")))
    w = Window.partitionBy(F.lit(1)).orderBy("d")  # some thousands of days
    snapped = F.first(F.when(F.col("trading"), F.col("d")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return days.withColumns({"session": F.sum(F.col("trading").cast("int")).over(w), "snapped": snapped})


CAL = f"""cal as (select d, trading, (sum(trading::int) over (order by d))::bigint as session from (select d, ({TRADING.replace('WD', 'dayofweek(d) between 1 and 5')}) as trading from (select unnest(generate_series(date '{FIRST_DAY}', date '{LAST_DAY}', interval 1 day))::date as d))),
od as (select cast(o_orderdate as date) as d, count(*) as orders from orders group by 1)"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, orders: the days of all orders."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("orders"))


@query("trading_days", f"with {CAL} select d::varchar as d, orders, trading, session from od left join cal using (d)")
def trading_days(spark, sf_dir):
    """The days of all orders: whether trading took place, and how many trading days there had been."""
    return order_days(spark, sf_dir).join(calendar(spark), "d", "left").select(F.col("d").cast("string").alias("d"), "orders", "trading", "session")


@query("next_trading_day", f"with {CAL} select a.d::varchar as d, (select min(b.d) from cal b where b.trading and b.d >= a.d)::varchar as snapped from od a")
def next_trading_day(spark, sf_dir):
    """The trading day on which an order of each day is carried out."""
    return order_days(spark, sf_dir).join(calendar(spark), "d", "left").select(F.col("d").cast("string").alias("d"), F.col("snapped").cast("string").alias("snapped"))


@query("add_trading_days", f"with {CAL} select a.d::varchar as d, n::int as n, min(b.d)::varchar as target from (select d, session from od join cal using (d)) a cross join (select unnest([1, 5, 20]) as n) left join cal b on b.trading and b.session = a.session + n group by 1, 2")
def add_trading_days(spark, sf_dir):
    """1, 5 and 20 trading days after the day of each order."""
    c = calendar(spark)
    a = order_days(spark, sf_dir).join(c, "d").select("d", "session", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))).alias("n")).withColumn("s", F.col("session") + F.col("n")).drop("session")
    b = c.where("trading").select(F.col("session").alias("s"), F.col("d").alias("target"))
    return a.join(b, "s", "left").select(F.col("d").cast("string").alias("d"), "n", F.col("target").cast("string").alias("target"))


AS_OF = "2001-11-10"
_GRADE = "case when gap <= 2 then 'fresh' when gap <= 5 then 'stale' when gap <= 10 then 'old' else 'dead' end"


@query("stale_sessions", f"""with {CAL}, x as (select l_returnflag as symbol, cast(max(l_shipdate) as date) as last from lineitem group by 1), g as (select symbol, last, count(d) as gap from x left join cal on d > last and d <= date '{AS_OF}' and trading group by 1, 2)
  select symbol, last::varchar as last, gap, {_GRADE} as grade from g""")
def stale_sessions(spark, sf_dir):
    return stale(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(F.max(F.col("l_shipdate").cast("date")).alias("last")), AS_OF)


def stale(x: DataFrame, as_of: str) -> DataFrame:
    """Trading days from each symbol's last bar to a day, with a grade: the difference of two session numbers."""
    c = calendar(x.sparkSession)
    now = c.where(F.col("d") == F.lit(as_of).cast("date")).select(F.col("session").alias("now"))  # one row
    g = x.join(c.select(F.col("d").alias("last"), "session"), "last").crossJoin(now).withColumn("gap", F.greatest(F.lit(0), F.col("now") - F.col("session")))
    return g.select("symbol", F.col("last").cast("string").alias("last"), "gap", F.expr(_GRADE).alias("grade"))


# ------------------------------------------------------------------------------------------- breadth and rotation
BREADTH = ", x as (select symbol, i, close / lag(close, 20) over (partition by symbol order by i) - 1 as r from bars), z as (select symbol, arg_max(r, i) as r from x group by 1)"


def breadth(b: DataFrame, members: int) -> DataFrame:
    """Normalised by the designed number of members: missing ones count as 0."""
    z = b.withColumn("r", F.col("close") / F.lag("close", 20).over(by()) - 1).groupBy("symbol").agg(F.max_by("r", "i").alias("r"))
    return z.agg((F.sum(F.signum("r")) / members).alias("breadth"), (F.sum(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r") * 100 / 8))) / members).alias("magnitude"))


@query("market_breadth", f"{BREADTH} select round(sum(sign(r)) / 5.0, 6) + 0.0 as breadth, round(sum(greatest(-1, least(1, r * 100 / 8))) / 5.0, 6) + 0.0 as magnitude from z", bars=True)
def market_breadth(spark, sf_dir):
    return breadth(bars(spark, sf_dir), 5).select(r6(F.col("breadth")).alias("breadth"), r6(F.col("magnitude")).alias("magnitude"))


@query("style_rotation", f"{BREADTH} select a.symbol as long_leg, b.symbol as short_leg, round((a.r - b.r) * 100, 4) + 0.0 as spread, case when a.r - b.r > 0.02 then 'leads' when a.r - b.r < -0.02 then 'lags' else 'even' end as state from z a join z b on a.symbol < b.symbol", bars=True)
def style_rotation(spark, sf_dir):
    z = bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close", 20).over(by()) - 1).groupBy("symbol").agg(F.max_by("r", "i").alias("r"))
    a, b = z.select(F.col("symbol").alias("long_leg"), F.col("r").alias("ra")), z.select(F.col("symbol").alias("short_leg"), F.col("r").alias("rb"))
    x = a.join(b, F.col("long_leg") < F.col("short_leg")).withColumn("d", F.col("ra") - F.col("rb"))
    return x.select("long_leg", "short_leg", (F.round(F.col("d") * 100, 4) + 0.0).alias("spread"), F.expr("case when d > 0.02D then 'leads' when d < -0.02D then 'lags' else 'even' end").alias("state"))
