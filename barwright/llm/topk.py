"""Exact top-k inner-product search with a paged M-tree, best first.

The tree's top level are pages: a bounded sample of vectors serves as routing vectors, every candidate belongs to the page
of its nearest routing vector (Euclidean), and a page has a covering radius. A page of many vectors is kept in several
parts. Below it, each part is an M-tree: nodes with a routing vector, a covering radius, and the distance to the parent's
routing vector. With routing vector c, radius r and |q| the query's length, no vector below a node scores more than
q.c + |q| r; before q.c is computed, the stored parent distance bounds it by q.p + |q| (d(c, p) + r), and a vector of a
leaf by q.p + |q| d(x, p).

Queries go to the page with the best bound first. Their k-th best score there goes with them into the second round, to
all pages whose bound still reaches it; within a page, nodes are visited best first until no bound reaches the k-th best
score so far. Results merge by score, ties to the smaller id. Integer components make all scores exact.

All rows are candidates; the queries are a stated set. How much is pruned depends on the data: next to nothing where all
vectors are about equally far from one another, as random ones of many dimensions are.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors are only compared
with those of their own dimension; a query without candidates has no row; rows that repeat a vec_id are candidates each,
but none is a candidate of the queries with its own id; queries that repeat both id and vector ask once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, write_shared
from .embedding_dups import matrix

#: Vectors of a part of a page, queries of a block, children of an inner node, vectors of a leaf, most pages.
PART, BLOCK, FAN, LEAF, PAGES = 16_384, 2_048, 16, 64, 1_024


class MTree:
    """Inner nodes of at most FAN entries and leaves of at most LEAF vectors over the rows of x, built top-down by nearest
    routing vectors. The rows of a node lie side by side; the leaves below one node are searched in one go, each vector only
    if its stored distances leave it a chance. `products` counts the inner products that searches compute."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.rng, self.products = np.random.default_rng(seed), 0
        self.order, self.x = np.arange(len(x)), x
        #: per node: child nodes (None above leaves), routing vectors, covering radii, distances to the parent's routing vector, first
        #: and last row, and above leaves the leaf of each row and its distance to that leaf's routing vector
        self.nodes: list[tuple] = []
        self.middle = x.mean(0) if len(x) else x.sum(0)
        self.root = self._build(0, len(x), self.middle)
        self.x = x[self.order]

    def _build(self, lo: int, hi: int, parent: np.ndarray) -> int:
        """A node over the rows; its entries keep their distance to the parent's routing vector."""
        rows = self.order[lo:hi].copy()
        own = self.x[rows]
        many = min(FAN, max(1, -(-len(rows) // LEAF)))
        route = own[self.rng.choice(len(rows), many, replace=False)] if len(rows) else own
        near = nearest(own, route)[0] if len(rows) else np.zeros(0, np.int64)
        sizes = np.bincount(near, minlength=len(route))
        if len(rows) > LEAF and sizes.max() == len(rows):  # equal vectors: deal them out
            near = np.arange(len(rows)) % many
            sizes = np.bincount(near, minlength=many)
        kept = np.flatnonzero(sizes)
        route, sizes, near = route[kept], sizes[kept], np.searchsorted(kept, near)
        sort = np.argsort(near, kind="stable")
        self.order[lo:hi] = rows[sort]
        near, far = near[sort], np.linalg.norm(own[sort] - route[near[sort]], axis=1) * (1 + 1e-12) + 1e-9
        cuts = np.append(0, np.cumsum(sizes))
        radii = np.array([far[i:j].max() for i, j in zip(cuts, cuts[1:])])
        away = np.linalg.norm(route - parent, axis=1) * (1 + 1e-12) + 1e-9
        kids = None if (sizes <= LEAF).all() else [self._build(lo + i, lo + j, r) for i, j, r in zip(cuts, cuts[1:], route)]
        self.nodes.append((kids, route, radii, away, lo, hi, near if kids is None else None, far if kids is None else None))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: int, known: float = -np.inf) -> list[tuple[float, int]]:
        """The k best (score, -id) for q among the rows whose id is not own, of those that score `known` or more. `ids` are those of
        the rows as they were given."""
        size = float(length(q))
        best: list[tuple[float, int]] = []
        todo = [(-np.inf, self.root, float(q @ self.middle))] if len(self.x) else []
        while todo:
            bound, node, at_parent = heapq.heappop(todo)
            floor = max(known, best[0][0]) if len(best) == k else known
            if -bound < floor:
                break
            kids, route, radii, away, lo, hi, leaf, far = self.nodes[node]
            live = np.flatnonzero(at_parent + size * (away + radii) >= floor)
            self.products += len(live)
            if not len(live):
                continue
            dots = route[live] @ q
            bounds = dots + size * radii[live]
            if kids is not None:
                for j, d, b in zip(live.tolist(), dots.tolist(), bounds.tolist()):
                    if b >= floor:
                        heapq.heappush(todo, (-b, kids[j], d))
                continue
            # leaves: what the stored distance to the leaf's routing vector leaves a chance
            chance = np.full(len(route), -np.inf)
            chance[live[bounds >= floor]] = dots[bounds >= floor]
            at = np.flatnonzero(chance[leaf] + size * far >= floor)
            self.products += len(at)
            score = (self.x[lo:hi] @ q)[at] if 2 * len(at) > hi - lo else self.x[lo + at] @ q
            name = ids[self.order[lo + at]]
            keep = (score >= floor) & (name != own)
            score, name = score[keep], name[keep]
            if len(score) > k:  # only what can be among the k best
                keep = score >= np.partition(score, -k)[-k]
                score, name = score[keep], name[keep]
            for v, i in zip(score.tolist(), name.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (v, -i))
                elif (v, -i) > best[0]:
                    heapq.heapreplace(best, (v, -i))
        return best


def length(q: np.ndarray) -> np.ndarray:
    """Lengths, a little rounded up, so that no bound is too small."""
    return np.sqrt((q * q).sum(-1)) * (1 + 1e-12) + 1e-9


def nearest(x: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest routing vector of each row and its distance (a little rounded up)."""
    sq = (x * x).sum(1)[:, None] - 2 * x @ route.T + (route * route).sum(1)
    at = sq.argmin(1)
    return at, np.linalg.norm(x - route[at], axis=1) * (1 + 1e-12) + 1e-9


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the components floor(scale * x) of the vectors that take part."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    good = vectors.where("vec_id is not null").where(F.coalesce((F.size(e) > 0) & ~F.exists(e, bad), F.lit(False)))
    return good.select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


FOUND = "query_id long, ask long, vec_id long, score long"


def search_pages(parts: DataFrame, asked: DataFrame, k: int, many: dict[int, int], block: int) -> DataFrame:
    """FOUND of the queries (vec_id, ask, v, known, page) in the pages they ask, `many` being the parts of each page. Each part
    and each block of queries that ask its page make one task's group."""
    blocks = {r["page"]: -(-r["n"] // block) for r in asked.groupBy("page").agg(F.count("*").alias("n")).collect()}  # one row per page
    lookup = lambda m: F.create_map(*[F.lit(int(x)) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<int,int>")
    upto = lambda m: F.sequence(F.lit(0), F.try_element_at(lookup(m), F.col("page")).cast("int") - 1)
    dealt = parts.where(F.try_element_at(lookup(blocks), F.col("page")).isNotNull()).select("vec_id", "v", "page", "part", F.explode(upto(blocks)).alias("block"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.try_element_at(lookup(blocks), F.col("page"))).cast("int")).select("vec_id", "ask", "v", "known", "page", F.explode(upto(many)).alias("part"), "block")

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if len(candidates) and len(asked):
            ids, tree = candidates.column("vec_id").to_numpy(), MTree(matrix(candidates.column("v")))
            for own, ask, q, known in zip(asked.column("vec_id").to_pylist(), asked.column("ask").to_pylist(), matrix(asked.column("v")), asked.column("known").to_pylist()):
                rows += [(own, ask, -i, int(s)) for s, i in tree.search(q, k, ids, own, known)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), (), ()))], names=["query_id", "ask", "vec_id", "score"])

    key = ["page", "part", "block"]
    return write_shared(dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, FOUND))


def top_k_of_one_dimension(vectors: DataFrame, queries: DataFrame, k: int, part: int, block: int) -> DataFrame:
    want = max(1, min(PAGES, -(-vectors.count() // part)))
    tops = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).select("v").collect()  # at most PAGES vectors
    route = np.array([r["v"] for r in tops], np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, away = nearest(matrix(batch.column(1)), route)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "page", "away"])

    placed = write_shared(vectors.mapInArrow(place, "vec_id long, v array<double>, page int, away double"))
    radius, many = np.full(len(route), -1.0), {}
    for r in placed.groupBy("page").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # one row per page
        radius[r["page"]], many[r["page"]] = r["r"], -(-r["n"] // (2 * part))
    parts = placed.select("vec_id", "v", "page", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in many.items() for x in kv]), F.col("page"))).cast("int").alias("part"))

    def visits(first: bool):
        """The page with the best bound, or all others whose bound reaches the known k-th best score."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    q = matrix(batch.column(2))
                    bound = np.where(radius >= 0, q @ route.T + length(q)[:, None] * radius, -np.inf)
                    best = bound.argmax(1)
                    known = batch.column(3).to_numpy(zero_copy_only=False)
                    into = (bound >= known[:, None]) & (radius >= 0)
                    into[np.arange(len(q)), best] = first
                    if first:
                        into = np.arange(len(route)) == best[:, None]
                    row, to = np.nonzero(into)
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to.astype(np.int32))], names=["vec_id", "ask", "v", "known", "page"])

        return visit

    # rows that repeat an id and its vector ask once; those with other vectors are queries of their own
    asked = write_shared(queries.select("vec_id", F.xxhash64("vec_id", "v").alias("ask"), "v").dropDuplicates(["vec_id", "ask"]))
    w = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = lambda f: f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    columns = "vec_id long, ask long, v array<double>, known double, page int"
    one = search_pages(parts, asked.select("vec_id", "ask", "v", F.lit(float("-inf")).alias("known")).mapInArrow(visits(True), columns), k, many, block)
    floor = ranked(one).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "ask", F.col("score").cast("double").alias("known"))
    rest = asked.join(floor, ["vec_id", "ask"], "left").select("vec_id", "ask", "v", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    two = search_pages(parts, write_shared(rest.mapInArrow(visits(False), columns)), k, many, block)
    return ranked(one.union(two)).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, v) of vectors and queries."""
    vectors, queries = (write_shared(x.select("vec_id", "v", F.size("v").alias("dim"))) for x in (vectors, queries))
    out = None
    for r in queries.select("dim").distinct().orderBy("dim").collect():  # one row per dimension
        own = lambda x, d=r["dim"]: x.where(F.col("dim") == d).select("vec_id", "v")
        one = top_k_of_one_dimension(own(vectors), own(queries), k, part, block)
        out = one if out is None else out.union(one)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
