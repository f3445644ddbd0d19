"""Rolling and window indicators. Frame statistics share one window per symbol; recursive filters (exponential means and
what is built on them) are affine maps composed over blocks of bars (`functions/recursions.py`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, clamp, full, lag, last, lead, mean, r6, std
from ..functions.recursions import exponential
from ..plans.registry import BARS_SQL, query
from ..sources.bars import WEEKS_SQL, bars, weekly_closes

P = "partition by symbol order by i"


def sql_last(f: str, x: str, n: int, need: bool = True) -> str:
    w = f"over ({P} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {f}({x}) {w} end" if need else f"{f}({x}) {w}"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# ---------------------------------------------------------------------------------------------- moving averages
@query("sma_set", f"select symbol, i, {', '.join(f'{r(sql_last("avg", "close", n))} as ma{n}' for n in (20, 60, 120, 250))} from bars", bars=True)
def sma_set(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "i", *[r6(mean("close", n)).alias(f"ma{n}") for n in (20, 60, 120, 250)])


def sql_ema(x: str, alpha: str, out: str, source: str) -> str:
    """A CTE of exponential means seeded by the first non-null value, as folds over prefixes."""
    return f"""{out} as (select symbol, i, case when {x} is not null then list_reduce(list({x}) filter ({x} is not null) over ({P}), lambda a, b: a + {alpha} * (b - a)) end as v from {source})"""


@query("ema_fast_slow", f", {sql_ema('close', '(2.0/13)', 'f', 'bars')}, {sql_ema('close', '(2.0/27)', 's', 'bars')} select f.symbol, f.i, round(f.v, 4) as fast, round(s.v, 4) as slow from f join s using (symbol, i)", bars=True)
def ema_fast_slow(spark, sf_dir):
    x = exponential(bars(spark, sf_dir), {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)})
    return x.select("symbol", "i", F.round("fast", 4).alias("fast"), F.round("slow", 4).alias("slow"))


def macd_columns(b: DataFrame) -> DataFrame:
    """Adds dif, dea and hist."""
    x = exponential(b, {"_f": ("close", 2 / 13), "_g": ("close", 2 / 27)}).withColumn("dif", F.col("_f") - F.col("_g")).drop("_f", "_g")
    return exponential(x, {"dea": ("dif", 2 / 10)}).withColumn("hist", 2 * (F.col("dif") - F.col("dea")))


@query("macd", f""", {sql_ema('close', '(2.0/13)', 'f', 'bars')}, {sql_ema('close', '(2.0/27)', 's', 'bars')},
  dif as (select f.symbol, f.i, f.v - s.v as x from f join s using (symbol, i)), {sql_ema('x', '(2.0/10)', 'dea', 'dif')}
  select dif.symbol, dif.i, round(x, 4) + 0.0 as dif, round(v, 4) + 0.0 as dea, round(2 * (x - v), 4) + 0.0 as hist from dif join dea using (symbol, i)""", bars=True)
def macd(spark, sf_dir):
    return macd_columns(bars(spark, sf_dir)).select("symbol", "i", *[(F.round(c, 4) + 0.0).alias(c) for c in ("dif", "dea", "hist")])


def rsi_columns(b: DataFrame, n: int = 14) -> DataFrame:
    """Adds rsi, null in the first n bars and where nothing has fallen."""
    x = b.withColumn("_m", F.col("close") - F.lag("close").over(by())).withColumns({"_u": F.greatest("_m", F.col("_m") * 0), "_d": F.greatest(-F.col("_m"), F.col("_m") * 0)})
    x = x.withColumns({c: F.when(F.col("_m").isNotNull(), F.col(c)) for c in ("_u", "_d")})
    x = exponential(x, {"_a": ("_u", 1 / n), "_e": ("_d", 1 / n)})
    return x.withColumn("rsi", F.when((F.col("i") >= n) & (F.col("_e") != 0), 100 - 100 / (1 + F.col("_a") / F.col("_e")))).drop("_m", "_u", "_d", "_a", "_e")


@query("rsi14", f""", m as (select symbol, i, close - lag(close) over ({P}) as x from bars), ud as (select symbol, i, case when x > 0 then x else x * 0 end as u, case when x < 0 then -x else x * 0 end as d from m),
  {sql_ema('u', '(1.0/14)', 'a', 'ud')}, {sql_ema('d', '(1.0/14)', 'b', 'ud')}
  select a.symbol, a.i, case when a.i >= 14 and b.v <> 0 then round(100 - 100 / (1 + a.v / b.v), 4) end as rsi from a join b using (symbol, i)""", bars=True)
def rsi14(spark, sf_dir):
    return rsi_columns(bars(spark, sf_dir)).select("symbol", "i", F.round("rsi", 4).alias("rsi"))


def moves(b: DataFrame) -> DataFrame:
    """Adds _p and _q (directional moves up and down) and _t (true range)."""
    x = b.withColumns({"_up": F.coalesce(F.col("high") - F.lag("high").over(by()), F.lit(0.0)), "_dn": F.coalesce(F.lag("low").over(by()) - F.col("low"), F.lit(0.0)), "_c": F.coalesce(F.lag("close").over(by()), "close")})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_c")), F.abs(F.col("low") - F.col("_c")))
    one = lambda a, b: F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0)
    return x.withColumns({"_p": one("_up", "_dn"), "_q": one("_dn", "_up"), "_t": tr}).drop("_up", "_dn", "_c")


def adx_columns(b: DataFrame, n: int = 14) -> DataFrame:
    """Adds adx, plus_di and minus_di by exponential means."""
    x = exponential(moves(b), {f"_e{c}": (f"_{c}", 1 / n) for c in "pqt"})
    di = lambda c: F.when(F.col("i") >= n - 1, 100 * F.col(c) / F.col("_et"))
    x = x.withColumns({"plus_di": di("_ep"), "minus_di": di("_eq")})
    total = F.col("plus_di") + F.col("minus_di")
    x = exponential(x.withColumn("_d", F.when(total != 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)), {"_a": ("_d", 1 / n)})
    return x.withColumn("adx", F.when(F.col("i") >= 2 * n - 2, F.col("_a"))).drop("_p", "_q", "_t", "_ep", "_eq", "_et", "_d", "_a")


#: Directional moves and true range of each bar.
_DM = f"""dm as (select symbol, i, case when up > dn and up > 0 then up else 0.0 end as plus, case when dn > up and dn > 0 then dn else 0.0 end as minus, tr from (
  select symbol, i, coalesce(high - lag(high) over ({P}), 0) as up, coalesce(lag(low) over ({P}) - low, 0) as dn, greatest(high - low, abs(high - coalesce(lag(close) over ({P}), close)), abs(low - coalesce(lag(close) over ({P}), close))) as tr from bars))"""


def _adx_sql() -> str:
    mask = lambda x, n: f"case when i >= {n} then {x} end"
    emas = ", ".join(sql_ema(c, "(1.0/14)", f"e_{c}", "dm") for c in ("plus", "minus", "tr"))
    return f""", {_DM}, {emas}, di as (select p.symbol, p.i, {mask('100 * p.v / t.v', 13).replace(' i ', ' p.i ')} as pdi, {mask('100 * m.v / t.v', 13).replace(' i ', ' p.i ')} as mdi from e_plus p join e_minus m using (symbol, i) join e_tr t using (symbol, i)),
dx as (select *, case when pdi + mdi <> 0 then 100 * abs(pdi - mdi) / (pdi + mdi) end as d from di), {sql_ema('d', '(1.0/14)', 'ax', 'dx')},
adx as (select dx.symbol, dx.i, case when dx.i >= 26 then ax.v end as adx, pdi, mdi from dx join ax using (symbol, i))"""


@query("adx_ewm", _adx_sql() + " select symbol, i, round(adx, 4) as adx, round(pdi, 4) as plus_di, round(mdi, 4) as minus_di from adx", bars=True)
def adx_ewm(spark, sf_dir):
    return adx_columns(bars(spark, sf_dir)).select("symbol", "i", *[F.round(c, 4).alias(c) for c in ("adx", "plus_di", "minus_di")])


def trend_strength(b: DataFrame, n: int = 14) -> DataFrame:
    """symbol, adx, pdi, mdi of the last bar; all means begin at simple means of n values and are smoothed from the n-th move on.
    Symbols with fewer than 2 n moves have none."""
    x = moves(b)
    seed = x.where(F.col("i").between(1, n)).groupBy("symbol").agg(*[F.avg(f"_{c}").alias(f"_s{c}") for c in "pqt"])
    x = x.join(seed, "symbol").withColumns({f"_x{c}": F.when(F.col("i") >= n, F.col(f"_{c}")) for c in "pqt"})
    x = exponential(x, {f"_e{c}": (f"_x{c}", 1 / n, f"_s{c}") for c in "pqt"}).where(F.col("i") >= n)
    x = x.withColumns({f"{d}di": F.when(F.col("_et") != 0, 100 * F.col(f"_e{c}") / F.col("_et")).otherwise(0.0) for d, c in (("p", "p"), ("m", "q"))})
    total = F.col("pdi") + F.col("mdi")
    x = x.withColumn("_d", F.when(total > 0, 100 * F.abs(F.col("pdi") - F.col("mdi")) / total).otherwise(0.0)).select("symbol", "i", "pdi", "mdi", "_d")
    first = x.where(F.col("i") < 2 * n).groupBy("symbol").agg(F.avg("_d").alias("_f"), F.count("*").alias("_k")).where(F.col("_k") == n)
    x = exponential(x.join(first, "symbol").withColumn("_x", F.when(F.col("i") >= 2 * n, F.col("_d"))), {"_a": ("_x", 1 / n, "_f")})
    return x.where(F.col("i") >= 2 * n - 1).groupBy("symbol").agg(F.max_by(F.coalesce("_a", "_f"), "i").alias("adx"), F.max_by("pdi", "i").alias("pdi"), F.max_by("mdi", "i").alias("mdi"))


TREND_OF_ADX = "case when adx >= 25 then case when pdi > mdi then 'strong, up' else 'strong, down' end when adx >= 20 then 'middling' else 'ranging' end"


#: The same means as recursive tables, for a WITH RECURSIVE list: lx has the last adx of each symbol, dx the two directions.
WILDER_SQL = f""", {_DM}, seed as (select symbol, avg(tr) as tr, avg(plus) as plus, avg(minus) as minus from dm where i between 1 and 14 group by 1),
  w as (select s.symbol, 14 as i, (s.tr * 13 + d.tr) / 14 as tr, (s.plus * 13 + d.plus) / 14 as plus, (s.minus * 13 + d.minus) / 14 as minus from seed s join dm d on d.symbol = s.symbol and d.i = 14
    union all select w.symbol, d.i, (w.tr * 13 + d.tr) / 14, (w.plus * 13 + d.plus) / 14, (w.minus * 13 + d.minus) / 14 from w join dm d on d.symbol = w.symbol and d.i = w.i + 1),
  dx as materialized (select symbol, i, case when tr <> 0 then 100 * plus / tr else 0 end as pdi, case when tr <> 0 then 100 * minus / tr else 0 end as mdi, case when plus + minus > 0 and tr <> 0 then 100 * abs(plus - minus) / (plus + minus) else 0 end as d from w),
  ax as (select symbol, 27 as i, avg(d) as adx from dx where i between 14 and 27 group by 1 having count(*) = 14 union all select ax.symbol, d.i, (ax.adx * 13 + d.d) / 14 from ax join dx d on d.symbol = ax.symbol and d.i = ax.i + 1),
  lx as (select symbol, arg_max(adx, i) as adx, max(i) as i from ax group by 1)"""


@query("adx_wilder", f"""with recursive {{bars}}{WILDER_SQL}
  select lx.symbol, round(adx, 4) as adx, round(pdi, 4) as plus_di, round(mdi, 4) as minus_di, {TREND_OF_ADX} as trend from lx join dx using (symbol, i)""".replace("{bars}", BARS_SQL))
def adx_wilder(spark, sf_dir):
    x = trend_strength(bars(spark, sf_dir))
    return x.select("symbol", F.round("adx", 4).alias("adx"), F.round("pdi", 4).alias("plus_di"), F.round("mdi", 4).alias("minus_di"), F.expr(TREND_OF_ADX).alias("trend"))


@query("bollinger", f", x as (select symbol, i, {sql_last('avg', 'close', 20)} as m, {sql_last('stddev_samp', 'close', 20)} as s from bars) select symbol, i, {r('m')} as mid, {r('m + 2 * s')} as upper, {r('m - 2 * s')} as lower from x", bars=True)
def bollinger(spark, sf_dir):
    m, s = mean("close", 20), std("close", 20)
    return bars(spark, sf_dir).select("symbol", "i", r6(m).alias("mid"), r6(m + 2 * s).alias("upper"), r6(m - 2 * s).alias("lower"))


def obv_column():
    move = F.signum(F.col("close") - F.coalesce(F.col("before"), F.col("close")))
    return F.sum(F.col("volume") * move).over(by())


@query("obv", f", x as (select symbol, i, volume * coalesce(sign(close - lag(close) over ({P})), 0) as v from bars) select symbol, i, sum(v) over ({P}) + 0.0 as obv from x", bars=True)
def obv(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("before", lag("close")).select("symbol", "i", (obv_column() + 0.0).alias("obv"))


def donchian(n: int):
    w = last(n)
    return full((F.max("high").over(w) + F.min("low").over(w)) / 2, F.col("high"), n, w)


def sql_donchian(n: int) -> str:
    w = f"over ({P} rows between {n - 1} preceding and current row)"
    return f"case when count(*) {w} = {n} then (max(high) {w} + min(low) {w}) / 2 end"


@query("donchian_mid", f"select symbol, i, {', '.join(f'{r(sql_donchian(n))} as mid{n}' for n in (9, 26, 52))} from bars", bars=True)
def donchian_mid(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "i", *[r6(donchian(n)).alias(f"mid{n}") for n in (9, 26, 52)])


def ichimoku(b: DataFrame) -> DataFrame:
    b = b.withColumns({"tenkan": donchian(9), "kijun": donchian(26), "mid52": donchian(52)})
    return b.withColumns({"span_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2, 26).over(by()), "span_b": F.lag("mid52", 26).over(by())}).drop("mid52")


ICHIMOKU_SQL = f""", t as (select *, {sql_donchian(9)} as tenkan, {sql_donchian(26)} as kijun, {sql_donchian(52)} as m52 from bars),
  ich as (select *, lag((tenkan + kijun) / 2, 26) over ({P}) as span_a, lag(m52, 26) over ({P}) as span_b from t)"""


@query("ichimoku_lines", f"{ICHIMOKU_SQL} select symbol, i, {', '.join(f'{r(c)} as {c}' for c in ('tenkan', 'kijun', 'span_a', 'span_b'))} from ich", bars=True)
def ichimoku_lines(spark, sf_dir):
    return ichimoku(bars(spark, sf_dir)).select("symbol", "i", *[r6(F.col(c)).alias(c) for c in ("tenkan", "kijun", "span_a", "span_b")])


# ------------------------------------------------------------------------------------------------- volatility
def with_returns(b: DataFrame) -> DataFrame:
    before = lag("close")
    return b.withColumns({"ret": F.ln(F.col("close") / before), "simple": F.col("close") / before - 1})


RET = f", rt as (select *, ln(close / lag(close) over ({P})) as ret, close / lag(close) over ({P}) - 1 as simple from bars)"


@query("log_returns", f"{RET} select symbol, i, {r('ret')} as ret, {r('simple')} as simple from rt", bars=True)
def log_returns(spark, sf_dir):
    return with_returns(bars(spark, sf_dir)).select("symbol", "i", r6(F.col("ret")).alias("ret"), r6(F.col("simple")).alias("simple"))


def hv20(b: DataFrame) -> DataFrame:
    """hv: 20 log returns, sample deviation, annualised by 244 sessions, percent; six places."""
    return with_returns(b).withColumn("hv", F.round(std("ret", 20) * (244**0.5) * 100, 6))


HV = f"{RET}, hv as (select *, round({sql_last('stddev_samp', 'ret', 20)} * {244**0.5!r} * 100, 6) as hv from rt)"
LASTHV = ", lh as (select symbol, arg_max(hv, i) as now from hv group by 1)"


@query("hv20_pctile", f"{HV}{LASTHV} select symbol, any_value(now) as hv, round(100.0 * count(*) filter (hv < now) / count(hv), 4) as pctile from hv join lh using (symbol) group by symbol", bars=True)
def hv20_pctile(spark, sf_dir):
    h = hv20(bars(spark, sf_dir))
    now = h.groupBy("symbol").agg(F.max_by("hv", "i").alias("now"))
    return h.join(now, "symbol").groupBy("symbol").agg(F.first("now").alias("hv"), F.round(100.0 * F.count_if(F.col("hv") < F.col("now")) / F.count("hv"), 4).alias("pctile"))


@query("hv_pop", f"{RET} select symbol, i, {r(sql_last('stddev_pop', 'simple', 20) + f' * {252**0.5!r}')} as hv from rt".replace("case when", "(case when").replace("end *", "end) *"), bars=True)
def hv_pop(spark, sf_dir):
    x = with_returns(bars(spark, sf_dir))
    return x.select("symbol", "i", r6(full(F.stddev_pop("simple").over(last(20)), F.col("simple"), 20, last(20)) * (252**0.5)).alias("hv"))


@query("parkinson_vol", f"""{RET}, p as (select symbol, i, {sql_last('stddev_samp', 'ret', 20)} as cc, sqrt({sql_last('avg', 'power(ln(high / low), 2)', 20)} / (4 * ln(2.0))) as pk from rt)
  select symbol, i, {r('pk')} as pk, {r('sqrt(cc * pk)')} as blend from p""", bars=True)
def parkinson_vol(spark, sf_dir):
    pk = F.sqrt(mean(F.pow(F.ln(F.col("high") / F.col("low")), 2), 20) / (4 * F.ln(F.lit(2.0))))
    return with_returns(bars(spark, sf_dir)).select("symbol", "i", r6(pk).alias("pk"), r6(F.sqrt(std("ret", 20) * pk)).alias("blend"))


_EW = """with recursive {bars}{ret}, v0 as (select symbol, var_samp(ret) as v from rt where i between 1 and 60 group by 1 having count(ret) = 60),
  ew as (select symbol, 60 as i, v from v0 union all select ew.symbol, r.i, 0.94 * ew.v + 0.06 * r.ret * r.ret from ew join rt r on r.symbol = ew.symbol and r.i = ew.i + 1) """


def ewma_sigma(b: DataFrame, columns: list[str] = ("symbol", "i", "ret")) -> DataFrame:
    """The columns and sigma: exponentially weighted deviation (0.94), seeded by the variance of the first 60 returns."""

    x = with_returns(b)
    first = F.when(F.col("i").between(1, 60), F.col("ret"))
    seed = x.groupBy("symbol").agg(F.when(F.count(first) == 60, F.var_samp(first)).alias("_v"))
    x = exponential(x.join(seed, "symbol").withColumn("_q", F.when(F.col("i") > 60, F.col("ret") * F.col("ret"))), {"_w": ("_q", 0.06, "_v")})
    return x.select(*columns, F.sqrt(F.when(F.col("i") == 60, F.col("_v")).when(F.col("i") > 60, F.col("_w"))).alias("sigma"))


@query("ewma_vol", _EW.replace("{ret}", RET).replace("{bars}", BARS_SQL) + "select rt.symbol, rt.i, round(sqrt(v), 8) as sigma from rt left join ew using (symbol, i)")
def ewma_vol(spark, sf_dir):
    return ewma_sigma(bars(spark, sf_dir)).select("symbol", "i", F.round("sigma", 8).alias("sigma"))


@query("mean_reverting_vol", _EW.replace("{ret}", RET).replace("{bars}", BARS_SQL) + f", lr as (select rt.*, v, {sql_last('var_samp', 'ret', 250)} as lv from rt left join ew using (symbol, i)) select symbol, i, h::int as h, round(sqrt(lv + (v - lv) * (1 - power(0.97::double, h)) / (h * 0.03)), 8) as sigma from lr, (select unnest([20, 60, 120]) as h) where v is not null and lv is not null")
def mean_reverting_vol(spark, sf_dir):
    """Mean deviation a day over the next h days where the weighted variance returns to that of 250 days, by 3 percent a day."""
    x = ewma_sigma(bars(spark, sf_dir))
    lv = full(F.var_samp("ret").over(last(250)), F.col("ret"), 250, last(250))
    x = x.withColumn("lv", lv).where("sigma is not null and lv is not null").withColumn("h", F.explode(F.array(*[F.lit(h) for h in (20, 60, 120)])))
    return x.select("symbol", "i", "h", F.round(F.expr("sqrt(lv + (sigma * sigma - lv) * (1 - power(0.97D, h)) / (h * 0.03D))"), 8).alias("sigma"))


@query("realized_vol", f"{RET}, n as (select *, row_number() over (partition by symbol order by i desc) as k from rt) select symbol, round(stddev_pop(ret) * {244**0.5!r}, 6) as vol from n where k <= 244 group by 1", bars=True)
def realized_vol(spark, sf_dir):
    n = with_returns(bars(spark, sf_dir)).withColumn("k", F.row_number().over(by(order="i").orderBy(F.desc("i"))))
    return n.where("k <= 244").groupBy("symbol").agg(F.round(F.stddev_pop("ret") * (244**0.5), 6).alias("vol"))


@query("forward_vol", f", x as (select symbol, h, ln(lead(close, h) over (partition by symbol, h order by i) / close) as f from bars, (select unnest([5, 10, 20, 60]) as h)) select symbol, h, case when count(f) < 30 then 0.095 else round(stddev_pop(f), 6) end as sigma from x group by 1, 2".replace("lead(close, h)", "lead(close, h::int)"), bars=True)
def forward_vol(spark, sf_dir):
    b = bars(spark, sf_dir)
    hs = (5, 10, 20, 60)
    x = b.select("symbol", *[F.ln(lead("close", h) / F.col("close")).alias(f"f{h}") for h in hs])
    x = x.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in hs])).alias("x")).select("symbol", "x.h", "x.f")
    return x.groupBy("symbol", "h").agg(F.when(F.count("f") < 30, F.lit(0.095)).otherwise(F.round(F.stddev_pop("f"), 6)).alias("sigma"))


@query("regime_factor", f"{RET}, n as (select *, row_number() over (partition by symbol order by i desc) as k from rt) select symbol, round(greatest(0.6, least(1.8, stddev_pop(ret) filter (k <= 20) / stddev_pop(ret) filter (k <= 250))), 6) as factor from n group by 1", bars=True)
def regime_factor(spark, sf_dir):
    n = with_returns(bars(spark, sf_dir)).withColumn("k", F.row_number().over(by().orderBy(F.desc("i"))))
    tail = lambda m: F.stddev_pop(F.when(F.col("k") <= m, F.col("ret")))
    return n.groupBy("symbol").agg(F.round(clamp(tail(20) / tail(250), 0.6, 1.8), 6).alias("factor"))


WINDOWS = (20, 60, 120, 250)


def interpolated(values: dict[int, str], h) -> F.col:
    """Piecewise-linear value of columns at windows 20..250 for the horizon column h."""
    h = clamp(h, WINDOWS[0], WINDOWS[-1])
    out = F.col(values[WINDOWS[-1]])
    for a, b in list(zip(WINDOWS, WINDOWS[1:]))[::-1]:
        t = (h - a) / (b - a)
        out = F.when(h <= b, F.col(values[a]) * (1 - t) + F.col(values[b]) * t).otherwise(out)
    return out


def sql_interpolated(prefix: str, h: str) -> str:
    h = f"greatest(20.0, least(250.0, {h}))"
    out = f"{prefix}250"
    for a, b in list(zip(WINDOWS, WINDOWS[1:]))[::-1]:
        out = f"case when {h} <= {b} then {prefix}{a} * (1 - ({h} - {a}) / {b - a}) + {prefix}{b} * (({h} - {a}) / {b - a}) else {out} end"
    return f"({out})"


def term_structure(b: DataFrame) -> DataFrame:
    """s20..s250 and m20..m250: deviation and mean of log returns over each window (one window specification)."""
    return with_returns(b).withColumns({f"s{n}": std("ret", n) for n in WINDOWS} | {f"m{n}": mean("ret", n) for n in WINDOWS})


TERM = f"{RET}, term as (select *, {', '.join(f'{sql_last("stddev_samp", "ret", n)} as s{n}, {sql_last("avg", "ret", n)} as m{n}' for n in WINDOWS)} from rt)"


@query("vol_term_structure", f"{TERM} select symbol, i, h::int as h, {r(sql_interpolated('s', 'h'))} as sigma, {r(sql_interpolated('m', 'h'))} as mu from term, (select unnest([10, 40, 90, 150, 300]) as h)", bars=True)
def vol_term_structure(spark, sf_dir):
    t = term_structure(bars(spark, sf_dir)).withColumn("h", F.explode(F.array(*[F.lit(h) for h in (10, 40, 90, 150, 300)])))
    cols = lambda p: {n: f"{p}{n}" for n in WINDOWS}
    return t.select("symbol", "i", "h", r6(interpolated(cols("s"), F.col("h"))).alias("sigma"), r6(interpolated(cols("m"), F.col("h"))).alias("mu"))


def expanding_rank(h: DataFrame, x: str, out: str) -> DataFrame:
    """Adds the share (percent) of the values of x so far that are strictly below the current one; null where x is null or no
    number.

    By halves: at level l, blocks of 2^(l+1) rows have a left and a right half, and each row of a right half counts the smaller
    values of its left half, by a running sum over the block sorted by value. Any two rows meet at one level only, the highest
    bit in which their numbers differ. So a row is sorted once a level, Spark sorts (and spills), and no worker holds a series."""
    v = h.select("symbol", "i", F.when(~F.isnan(x), F.col(x)).alias("v"))
    v = v.withColumns({"seen": F.count("v").over(by()), "n": F.max("i").over(Window.partitionBy("symbol"))}).where("v is not null")
    bit = F.expr("array_max(filter(sequence(0, 30), l -> l = 0 or shiftleft(1, l) <= n))")
    v = v.withColumn("l", F.explode(F.sequence(F.lit(0), bit))).selectExpr("symbol", "i", "v", "seen", "l", "shiftright(i, l + 1) as block", "1 - (shiftright(i, l) & 1) as left")
    w = Window.partitionBy("symbol", "l", "block").orderBy("v", "left").rowsBetween(Window.unboundedPreceding, 0)  # at ties the right half comes first
    share = v.withColumn("below", F.sum("left").over(w)).groupBy("symbol", "i").agg((100.0 * F.sum(F.when(F.col("left") == 0, F.col("below")).otherwise(0)) / F.first("seen")).alias(out))
    return h.join(share, ["symbol", "i"], "left")


def band_scale(p):
    return F.when(p >= 66, 1.15).when(p >= 33, 1.0).otherwise(0.88)


PIT = f"{HV}, pit as (select a.symbol, a.i, case when a.hv is not null then 100.0 * count(*) filter (b.hv < a.hv) / count(b.hv) end as p from hv a join hv b on a.symbol = b.symbol and b.i <= a.i group by a.symbol, a.i, a.hv)"


@query("vol_scale_pit", f"{PIT} select symbol, i, round(p, 4) as pctile, case when p is null then 1.0 when p >= 66 then 1.15 when p >= 33 then 1.0 else 0.88 end::double as scale from pit", bars=True)
def vol_scale_pit(spark, sf_dir):
    h = expanding_rank(hv20(bars(spark, sf_dir)), "hv", "p")
    return h.select("symbol", "i", F.round("p", 4).alias("pctile"), F.when(F.col("p").isNull(), 1.0).otherwise(band_scale(F.col("p"))).alias("scale"))


@query("vol_regime_bucket", f"{PIT} select symbol, case when p >= 66 then 1.15 when p >= 33 then 1.0 else 0.88 end::double as band_scale, case when p >= 66 then 0.6 when p >= 33 then 0.85 else 1.0 end::double as drift_confidence from pit qualify row_number() over (partition by symbol order by i desc) = 1", bars=True)
def vol_regime_bucket(spark, sf_dir):
    h = expanding_rank(hv20(bars(spark, sf_dir)), "hv", "p").groupBy("symbol").agg(F.max_by("p", "i").alias("p"))
    return h.select("symbol", band_scale(F.col("p")).alias("band_scale"), F.when(F.col("p") >= 66, 0.6).when(F.col("p") >= 33, 0.85).otherwise(1.0).alias("drift_confidence"))


def trailing_rank(h: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Share (percent) of the last n non-null values that are at most the current one."""
    h = h.withColumn("_seen", F.collect_list(x).over(last(n)))
    return h.withColumn(out, F.when(F.col(x).isNotNull(), 100.0 * F.size(F.filter("_seen", lambda v: v <= F.col(x))) / F.size("_seen"))).drop("_seen")


@query("pct_rank_250", f"{HV} select a.symbol, a.i, round(100.0 * count(*) filter (b.hv <= a.hv) / count(b.hv), 4) as pctile from hv a join hv b on a.symbol = b.symbol and b.i between a.i - 249 and a.i where a.hv is not null group by 1, 2", bars=True)
def pct_rank_250(spark, sf_dir):
    return trailing_rank(hv20(bars(spark, sf_dir)), "hv", 250, "p").where("hv is not null").select("symbol", "i", F.round("p", 4).alias("pctile"))


@query("regime_pct_rank", f""", g as (select symbol, i, close, close < {sql_last('avg', 'close', 250)} as bear from bars) select a.symbol, a.i, a.bear, round(100.0 * count(*) filter (b.close <= a.close) / count(*), 4) as pctile
  from g a join g b on a.symbol = b.symbol and b.i between a.i - 249 and a.i and a.bear = b.bear group by 1, 2, 3""", bars=True)
def regime_pct_rank(spark, sf_dir):
    """Rank of the close among those of the last 250 sessions that were in the same regime (below the 250-day mean)."""
    g = bars(spark, sf_dir).withColumn("bear", F.col("close") < mean("close", 250))
    g = g.withColumn("_w", F.collect_list(F.struct("close", "bear")).over(last(250))).where("bear is not null")
    own = F.filter("_w", lambda v: v["bear"] == F.col("bear"))
    return g.select("symbol", "i", "bear", F.round(100.0 * F.size(F.filter(own, lambda v: v["close"] <= F.col("close"))) / F.size(own), 4).alias("pctile"))


@query("zscore_120", f", x as (select symbol, i, close, {sql_last('avg', 'close', 120, False)} as m, {sql_last('stddev_pop', 'close', 120, False)} as s from bars) select symbol, i, round(case when s <= 1e-6 then 0 else (close - m) / s end, 4) + 0.0 as z from x", bars=True)
def zscore_120(spark, sf_dir):
    m, s = F.avg("close").over(last(120)), F.stddev_pop("close").over(last(120))
    return bars(spark, sf_dir).select("symbol", "i", (F.round(F.when(s <= 1e-6, F.lit(0.0)).otherwise((F.col("close") - m) / s), 4) + 0.0).alias("z"))


@query("lag_diffs", f"select symbol, i, {r(f'close - lag(close, 5) over ({P})')} as d5, {r(f'close - lag(close, 20) over ({P})')} as d20 from bars", bars=True)
def lag_diffs(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "i", r6(F.col("close") - lag("close", 5)).alias("d5"), r6(F.col("close") - lag("close", 20)).alias("d20"))


VR = f", vr as (select symbol, i, {sql_last('avg', 'volume', 20)} / ({sql_last('avg', 'volume', 250)}) - 1 as vr from bars)"


def volume_ratios(b: DataFrame) -> DataFrame:
    return b.withColumn("vr", mean("volume", 20) / mean("volume", 250) - 1)


@query("volume_ratio", f"{VR}, s as (select symbol, case when count(vr) < 30 then 0.5 else greatest(0.08, stddev_pop(vr)) end as div from vr group by 1) select symbol, i, {r('vr')} as vr, {r('greatest(-1, least(1, vr / div))')} as sub from vr join s using (symbol) where vr is not null", bars=True)
def volume_ratio(spark, sf_dir):
    v = volume_ratios(bars(spark, sf_dir))
    s = v.groupBy("symbol").agg(F.when(F.count("vr") < 30, F.lit(0.5)).otherwise(F.greatest(F.lit(0.08), F.stddev_pop("vr"))).alias("div"))
    return v.join(s, "symbol").where("vr is not null").select("symbol", "i", r6(F.col("vr")).alias("vr"), r6(clamp(F.col("vr") / F.col("div"), -1.0, 1.0)).alias("sub"))


MA = f", ma as (select *, {', '.join(f'{sql_last("avg", "close", n)} as ma{n}' for n in (20, 60, 250))}, {sql_last('avg', 'volume', 20)} as v20, {sql_last('avg', 'volume', 60)} as v60 from bars)"


@query("ma_alignment", f"{MA} select symbol, i, case when ma20 > ma60 and ma60 > ma250 then 'bull' when ma20 < ma60 and ma60 < ma250 then 'bear' else 'mixed' end as state from ma where ma250 is not null", bars=True)
def ma_alignment(spark, sf_dir):
    m = bars(spark, sf_dir).withColumns({f"ma{n}": mean("close", n) for n in (20, 60, 250)}).where("ma250 is not null")
    return m.select("symbol", "i", F.expr("case when ma20 > ma60 and ma60 > ma250 then 'bull' when ma20 < ma60 and ma60 < ma250 then 'bear' else 'mixed' end").alias("state"))


BIAS = "case when b >= 10 then 'extreme_high' when b >= 6 then 'high' when b >= 3 then 'raised' when b <= -10 then 'extreme_low' when b <= -6 then 'low' when b <= -3 then 'lowered' else 'normal' end"


@query("bias_state", f"{MA}, x as (select symbol, i, round((close / ma20 - 1) * 100, 4) + 0.0 as b from ma where ma20 is not null) select symbol, i, b as bias, {BIAS} as state from x", bars=True)
def bias_state(spark, sf_dir):
    x = bars(spark, sf_dir).withColumn("m", mean("close", 20)).where("m is not null").withColumn("b", F.round((F.col("close") / F.col("m") - 1) * 100, 4) + 0.0)
    return x.select("symbol", "i", F.col("b").alias("bias"), F.expr(BIAS).alias("state"))


@query("max_drawdown", f""", p as (select symbol, i, date, close, max(close) over ({P}) as pk from bars), q as (select *, close / pk - 1 as dd from p)
  select symbol, round(min(dd), 6) as max_drawdown, arg_min(date, (dd, i))::varchar as trough, arg_min(pk, (dd, i)) as peak_close from q group by 1""", bars=True)
def max_drawdown(spark, sf_dir):
    """Deepest fall from the running peak, with the peak before that trough."""
    q = bars(spark, sf_dir).withColumn("pk", F.max("close").over(by())).withColumn("dd", F.col("close") / F.col("pk") - 1)
    at = F.struct("dd", "i")
    return q.groupBy("symbol").agg(F.round(F.min("dd"), 6).alias("max_drawdown"), F.min_by("date", at).cast("string").alias("trough"), F.min_by("pk", at).alias("peak_close"))


@query("vol_trend", f"{MA} select symbol, i, case when v20 / v60 > 1.15 then 'rising' when v20 / v60 < 0.85 then 'falling' else 'flat' end as trend from ma where v60 is not null", bars=True)
def vol_trend(spark, sf_dir):
    m = bars(spark, sf_dir).withColumn("x", mean("volume", 20) / mean("volume", 60)).where("x is not null")
    return m.select("symbol", "i", F.expr("case when x > 1.15 then 'rising' when x < 0.85 then 'falling' else 'flat' end").alias("trend"))


@query("weekly_ma30", WEEKS_SQL + ", x as (select *, case when wi >= 29 then avg(close) over (partition by symbol order by wi rows between 29 preceding and current row) end as m from weeks) select symbol, week::varchar as week, round(m, 6) as ma30, coalesce(close > m, false) as above from x", bars=True)
def weekly_ma30(spark, sf_dir):
    w = by(order="wi").rowsBetween(-29, 0)
    x = weekly_closes(bars(spark, sf_dir)).withColumn("m", F.when(F.col("wi") >= 29, F.avg("close").over(w)))
    return x.select("symbol", F.col("week").cast("string").alias("week"), F.round("m", 6).alias("ma30"), F.coalesce(F.col("close") > F.col("m"), F.lit(False)).alias("above"))


@query("return_20", f", x as (select *, close / lag(close, 20) over ({P}) - 1 as r20 from bars) select symbol, round(arg_max(r20, i), 6) + 0.0 as ret20 from x group by 1", bars=True)
def return_20(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("x", F.col("close") / lag("close", 20) - 1).groupBy("symbol").agg(r6(F.max_by("x", "i")).alias("ret20"))


PEAK = f"over ({P} rows between 5 preceding and 5 following)"


@query("local_peaks", f", x as (select symbol, i, high, max(high) {PEAK} as m, count(*) {PEAK} as n from bars) select symbol, i, high from x where n = 11 and high = m", bars=True)
def local_peaks(spark, sf_dir):
    w = by().rowsBetween(-5, 5)
    return bars(spark, sf_dir).withColumns({"m": F.max("high").over(w), "n": F.count("*").over(w)}).where("n = 11 and high = m").select("symbol", "i", "high")


def forward_extremes(b: DataFrame, horizons=(20, 60, 120)) -> DataFrame:
    """hi{h}, lo{h}: extremes of the next h bars; null where fewer follow."""
    out = {}
    for h in horizons:
        w = by().rowsBetween(1, h)
        out |= {f"hi{h}": full(F.max("high").over(w), F.col("high"), h, w), f"lo{h}": full(F.min("low").over(w), F.col("low"), h, w)}
    return b.withColumns(out)


def sql_forward(h: int) -> str:
    w = f"over ({P} rows between 1 following and {h} following)"
    return f"case when count(*) {w} = {h} then max(high) {w} end as hi{h}, case when count(*) {w} = {h} then min(low) {w} end as lo{h}"


@query("forward_extremes", f"select symbol, i, {', '.join(map(sql_forward, (20, 60, 120)))} from bars", bars=True)
def forward_extremes_query(spark, sf_dir):
    return forward_extremes(bars(spark, sf_dir)).select("symbol", "i", *[f"{k}{h}" for h in (20, 60, 120) for k in ("hi", "lo")])


AFTER = f"over ({P} rows between 1 following and unbounded following)"


#: Walk bars open where the last one closed and so never gap; bars of the closing price alone do.
CLOSES_SQL = ", cl as (select symbol, date, i, close as high, close as low, close from bars)"


def closing_bars(b: DataFrame) -> DataFrame:
    return b.select("symbol", "date", "i", F.col("close").alias("high"), F.col("close").alias("low"), "close")


def gaps(b: DataFrame, least: float = 0.003) -> DataFrame:
    """symbol, i, dir, lo, hi, filled: bars that leave a gap of at least `least` to the bar before, and whether any later bar
    comes back to its far side."""
    after = by().rowsBetween(1, 2**31 - 1)
    g = b.withColumns({"ph": lag("high"), "pl": lag("low"), "nl": F.min("low").over(after), "nh": F.max("high").over(after)})
    g = g.where((F.col("low") > F.col("ph")) & ((F.col("low") - F.col("ph")) / F.col("ph") >= least) | (F.col("high") < F.col("pl")) & ((F.col("pl") - F.col("high")) / F.col("high") >= least))
    up = F.col("low") > F.col("ph")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    filled = F.when(up, F.col("nl") <= F.col("ph")).otherwise(F.col("nh") >= F.col("pl"))
    return g.select("symbol", "i", F.when(up, "up").otherwise("down").alias("dir"), pick("ph", "high").alias("lo"), pick("low", "pl").alias("hi"), F.coalesce(filled, F.lit(False)).alias("filled"))


GAPS_SQL = CLOSES_SQL + f""", gp0 as (select *, lag(high) over ({P}) as ph, lag(low) over ({P}) as pl, min(low) {AFTER} as nl, max(high) {AFTER} as nh from cl),
gp as (select symbol, i, case when low > ph then 'up' else 'down' end as dir, case when low > ph then ph else high end as lo, case when low > ph then low else pl end as hi,
  coalesce(case when low > ph then nl <= ph else nh >= pl end, false) as filled from gp0 where (low > ph and (low - ph) / ph >= 0.003) or (high < pl and (pl - high) / high >= 0.003))"""


@query("price_gaps", GAPS_SQL + " select * from gp", bars=True)
def price_gaps(spark, sf_dir):
    return gaps(closing_bars(bars(spark, sf_dir)))


@query("nearest_gaps", GAPS_SQL + ", ng as (select gp.*, c, case when (lo + hi) / 2 <= c then 'below' else 'above' end as side from gp join (select symbol, arg_max(close, i) as c from bars group by 1) using (symbol) where not filled) select symbol, i, side, dir, lo, hi from ng qualify row_number() over (partition by symbol, side order by abs((lo + hi) / 2 - c), i desc) = 1", bars=True)
def nearest_gaps(spark, sf_dir):
    """The nearest open gap below and above the last close."""
    b = bars(spark, sf_dir)
    g = gaps(closing_bars(b)).where("not filled").join(b.groupBy("symbol").agg(F.max_by("close", "i").alias("c")), "symbol").withColumn("side", F.expr("case when (lo + hi) / 2 <= c then 'below' else 'above' end"))
    k = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("c")), F.desc("i")))
    return g.withColumn("k", k).where("k = 1").select("symbol", "i", "side", "dir", "lo", "hi")


@query("visible_gaps", GAPS_SQL + " select symbol, i, dir, lo, hi from (select gp.*, c from gp join (select symbol, arg_max(close, i) as c from bars group by 1) using (symbol) where not filled and abs((hi + lo) / 2 / c - 1) <= 0.15) qualify row_number() over (partition by symbol order by i desc) <= 5", bars=True)
def visible_gaps(spark, sf_dir):
    """Open gaps within 15 percent of the last close, the latest five."""
    b = bars(spark, sf_dir)
    c = b.groupBy("symbol").agg(F.max_by("close", "i").alias("c"))
    g = gaps(closing_bars(b)).where("not filled").join(c, "symbol").where("abs((hi + lo) / 2 / c - 1) <= 0.15D")
    return g.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))).where("k <= 5").select("symbol", "i", "dir", "lo", "hi")


TR = f", tr as (select *, greatest(high - low, abs(high - lag(close) over ({P})), abs(low - lag(close) over ({P}))) as tr from bars)"


@query("atr14", f"{TR} select symbol, i, {r(sql_last('avg', 'tr', 14))} as atr from tr", bars=True)
def atr14(spark, sf_dir):
    before = lag("close")
    x = bars(spark, sf_dir).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return x.select("symbol", "i", r6(mean("tr", 14)).alias("atr"))


@query("loglin_trend", """, n as (select *, row_number() over (partition by symbol order by i desc) as k from bars) select symbol, w::int as w, round(regr_slope(ln(close), i), 8) + 0.0 as slope, round(regr_r2(ln(close), i), 6) as r2
  from n, (select unnest([20, 60, 120]) as w) where k <= w group by 1, 2""", bars=True)
def loglin_trend(spark, sf_dir):
    n = bars(spark, sf_dir).withColumn("k", F.row_number().over(by().orderBy(F.desc("i"))))
    n = n.withColumn("w", F.explode(F.array(F.lit(20), F.lit(60), F.lit(120)))).where("k <= w")
    y = F.ln("close")
    return n.groupBy("symbol", "w").agg((F.round(F.regr_slope(y, F.col("i")), 8) + 0.0).alias("slope"), F.round(F.regr_r2(y, F.col("i")), 6).alias("r2"))
