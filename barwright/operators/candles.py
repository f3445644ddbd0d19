"""Candlestick patterns as predicates over a bar and its two predecessors, and their vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by
from ..plans.registry import query
from ..sources.bars import bars

GEOMETRY = {
    "body": "abs(close - open)", "rng": "high - low",
    "us": "high - greatest(open, close)", "ls": "least(open, close) - low",
    "bull": "close > open", "bear": "close < open",
}
LAGGED = ("open", "high", "low", "close", "body", "rng", "bull", "bear")
#: pattern: (score 1 condition, score -1 condition), over the bar and its predecessors (suffixes 1 and 2).
PATTERNS = {
    "hammer": ("ls >= 2 * body and us < body and body > 0 and rng > 0", None),
    "inverted_hammer": ("us >= 2 * body and ls < body and body > 0", None),
    "shooting_star": (None, "us >= 2 * body and ls < body and body > 0 and close1 > close2"),
    "doji": ("rng > 0 and body < 0.1 * rng", None),
    "spinning_top": ("rng > 0 and body < 0.3 * rng and body >= 0.1 * rng and us > body and ls > body", None),
    "engulfing": ("bear1 and bull and open <= close1 and close >= open1", "bull1 and bear and open >= close1 and close <= open1"),
    "harami": ("bear1 and bull and body < body1 and open >= close1 and close <= open1", "bull1 and bear and body < body1 and open <= close1 and close >= open1"),
    "piercing_line": ("bear1 and bull and open < low1 and close > (open1 + close1) / 2 and close < open1", None),
    "dark_cloud": (None, "bull1 and bear and open > high1 and close < (open1 + close1) / 2 and close > open1"),
    "morning_star": ("bear2 and rng1 > 0 and body1 < 0.3 * rng1 and greatest(open1, close1) <= close2 and bull and close > (open2 + close2) / 2", None),
    "evening_star": (None, "bull2 and rng1 > 0 and body1 < 0.3 * rng1 and least(open1, close1) >= close2 and bear and close < (open2 + close2) / 2"),
    "white_soldiers": ("bull2 and bull1 and bull and close > close1 and close1 > close2 and open >= open1 and open <= close1 and open1 >= open2 and open1 <= close2", None),
    "black_crows": (None, "bear2 and bear1 and bear and close < close1 and close1 < close2 and open <= open1 and open >= close1 and open1 <= open2 and open1 >= close2"),
}
#: Patterns without a direction: they are flagged but score 0 in the vote.
NEUTRAL = ("doji", "spinning_top")


def geometry(b: DataFrame) -> DataFrame:
    b = b.withColumns({k: F.expr(v) for k, v in GEOMETRY.items()})
    return b.withColumns({f"{c}{n}": F.lag(c, n).over(by()) for c in LAGGED for n in (1, 2)})


def score(name: str) -> str:
    up, down = PATTERNS[name]
    return "(case " + (f"when {up} then 1 " if up else "") + (f"when {down} then -1 " if down else "") + "else 0 end)"


def vote() -> str:
    return " + ".join(score(n) for n in PATTERNS if n not in NEUTRAL)


def candle_vote(b: DataFrame) -> DataFrame:
    return geometry(b).withColumn("signal", F.signum(F.expr(vote())).cast("int"))


CANDLES = ", geo as (select *, " + ", ".join(f"{v} as {k}" for k, v in GEOMETRY.items()) + " from bars), cnd as (select *, " + ", ".join(f"lag({c}, {n}) over (partition by symbol order by i) as {c}{n}" for c in LAGGED for n in (1, 2)) + " from geo) "


def _register(name: str) -> None:
    @query(f"candle_{name}", f"{CANDLES} select symbol, i, {score(name)} as flag from cnd", bars=True)
    def run(spark, sf_dir):
        return geometry(bars(spark, sf_dir)).select("symbol", "i", F.expr(score(name)).alias("flag"))


for _name in PATTERNS:
    _register(_name)


@query("candle_vote", f"{CANDLES} select symbol, i, sign({vote()})::int as signal from cnd", bars=True)
def candle_vote_query(spark, sf_dir):
    return candle_vote(bars(spark, sf_dir)).select("symbol", "i", "signal")
