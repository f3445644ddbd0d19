"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Prefix sums of each document's expected copies are taken within its source, one random offset per source is
added, and a document is emitted once per integer boundary that its interval crosses. All documents of a source
expect the same number of copies, so the prefix sum is the document's rank times that number; ranks follow size
first, which spreads the sample over all sizes and keeps the words taken within one document of the target.

Edge cases: a null text has size 0; a null source is a source of its own, last; a source whose documents are all
empty has target 0 and takes nothing; rows that repeat an id are separate documents; null ids rank first; an
empty table gives an empty result. Extra columns of the input are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prefix_sum, write_shared

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    The targets split share * (all sizes) by weight and stop at ceiling * (source size); what is cut off is shared
    again by weight. That fixed point is min(cap, weight * level): with sources sorted by cap / weight, the level is
    the first one at which the next source is not capped. One row per source is windowed, nothing else: the sources of a
    mix are a list that people keep, some thousands at most.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(1))
    n = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights)).cast("int") + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(ceiling))
    order = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "source_size", "weight", "cap", F.row_number().over(order).alias("at"), (F.col("cap") / F.col("weight")).alias("ratio"),
        (F.sum("source_size").over(one) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("rest"),
    )
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(one)
    per = per.withColumn("level", found["level"])
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def offset_of(source, seed: str):
    """The source's one random offset, in (0, 1), from the seed; 16 bits, so that sums with ranks stay exact."""
    key = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0


def word_counts(docs: DataFrame):
    """The number of words of each text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix:") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs. The texts are read once: all that follows works
    on (doc_id, source, size), written to the shared folder."""
    rows = write_shared(docs.select("doc_id", "source", word_counts(docs).alias("size")))
    targets = source_targets(rows.select("source", "size"), weights, share, ceiling)
    # rank within the source: documents of smaller size, then documents of the same size with smaller id
    per = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "size", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("smaller"))
    targets = targets.withColumnRenamed("source", "_t")
    per = per.join(targets, F.col("source").eqNullSafe(F.col("_t"))).drop("_t").withColumnsRenamed({"source": "_s", "size": "_z"})
    ranked = prefix_sum(rows.withColumn("one", F.lit(1)), ["source", "size"], "doc_id", "one", "among")
    both = ranked.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    rank, u = F.col("smaller") + F.col("among"), offset_of(F.col("source"), seed)
    copies = F.floor(F.col("rate") * (rank + 1) + u) - F.floor(F.col("rate") * rank + u)
    copies = F.least(copies, F.lit(int(-(-ceiling // 1)))).cast("long")
    return both.withColumn("copies", copies).drop("one", "smaller", "among", "rate")


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. The copies are found without the
    texts; the rows are then joined once by id, source and size. Rows that repeat all three share out their copies."""
    key = lambda size: F.struct("doc_id", "source", size.alias("size")).alias("key")
    taken = mix_sources(docs, **options).groupBy(key(F.col("size"))).agg(F.sort_array(F.collect_list("copies")).alias("lots")).where(F.exists("lots", lambda x: x > 0))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(word_counts(docs)))
    both = rows.join(taken, "key").withColumn("lot", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text"))))
    both = both.select("row", F.element_at("lots", F.col("lot")).cast("int").alias("copies")).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The size of a document for DuckDB and the same fixed point; the ranks as one window.
OP10_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([3, 1, 2])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, source_size * 2.0::double as cap from p),
c as (select *, cap / weight as ratio, row_number() over (order by cap / weight, source nulls last) as pos, sum(source_size) over () * 1.5::double as total,
  coalesce(sum(cap) over o, 0.0) as capped, sum(weight) over () - coalesce(sum(weight) over o, 0) as rest
  from w window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (total - capped) / rest as level from c),
m as (select *, arg_min(case when level <= ratio then level end, case when level <= ratio then pos end) over () as lam from l),
t as (select source, source_size, least(cap, coalesce(weight * lam, cap)) as target,
  (('0x' || substr(md5('mix:' || case when source is null then 'n' else 's' || source end), 1, 4))::bigint::double + 0.5) / 65536.0 as u from m),
r as (select d.doc_id, d.size, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
  row_number() over (partition by d.source order by d.size, d.doc_id nulls first) - 1 as k
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  least(2, (floor(rate * (k + 1) + u) - floor(rate * k + u)))::bigint * size as taken from r
"""
