"""Embedding near-dedup with cover trees and dual traversal.

Vectors are scaled to length 1, so cosine >= c is distance <= sqrt(2 - 2c). A bounded sample of vectors serves as the
centres of the top level; every vector goes to the cell of its nearest centre, which has a covering radius. Each block of
a cell is a cover tree (separated, covering, nested levels whose radii halve), and two blocks are compared by a traversal of
both trees from their roots: a pair of nodes is left as soon as the distance of their centres exceeds the sum of their
covering radii and the threshold; the pairs that remain at the leaves are compared exactly in double precision. A vector
is sent to another cell only if it lies within that cell's radius plus the threshold, each pair of cells being compared at
the one with the smaller number. Vectors of different dimensions never link; each dimension is searched by itself.

Equal vectors are one row that stands for all of them. Links are counted, not listed: for a pair of blocks, a task sends
per vector its number of links and one vector that links lead to, which is a spanning set of each group. No group is
expanded into rows of all pairs.

Edge cases: vectors that are null, of length 0, or that hold a null or non-finite component link with nothing and keep
themselves; equal vectors link; rows that repeat a vec_id are one vector each, with links of their own, and share the
component of the id; null ids link with nothing and have a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, write_shared

#: The most vectors that serve as centres of cells, and the vectors that a cell is meant to hold.
CENTRES, CELL = 1024, 2048
SLACK = 1e-9


def usable(embedding) -> F.col:
    """True for vectors whose components are all finite numbers and not all zero."""
    e = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class CoverTree:
    """A cover tree over the rows of x (of length 1). The centres of a level are more than its radius apart (separation),
    every row is within that radius of one of them (covering), they are centres of all lower levels too (nesting), and
    the radii halve from level to level. A centre of the next level hangs below the nearest one of this level.

    Levels at which a node has but itself as a child are left out; nodes of at most LEAF rows are leaves, and so are the nodes of
    the last level that still brings rows together (random vectors of many dimensions have none). Each node keeps
    the true covering radius of its rows, which lie side by side in `order`."""

    LEAF, LEAST, STEP = 16, 1e-3, 64

    def __init__(self, x: np.ndarray):
        self.x = x
        #: per level: its radius and the centre nearest to each row
        self.levels: list[tuple[float, np.ndarray]] = []
        n = len(x)
        if n:
            self._nets()
        below = []  # per level: the centre above each row
        group = np.arange(n)
        for _, owner in reversed(self.levels):
            group = owner[group]
            below.append(group)
        self.group = below[::-1]
        self.order = np.lexsort([np.arange(n), *below]) if n else np.arange(0)
        #: per node: centre row, covering radius, first and last place in order, child nodes
        self.centre, self.cover, self.lo, self.hi, self.kids = [], [], [], [], []
        if n:
            self._node(0, 0, n)
        self.centre, self.lo, self.hi = (np.array(v, np.int64) for v in (self.centre, self.lo, self.hi))
        self.cover = np.array(self.cover)

    def _far(self, rows, others=slice(None)) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[others].T), 0))

    def _nets(self) -> None:
        near, owner = self._far(0), np.zeros(len(self.x), np.int64)
        near[0] = 0.0
        radius = float(near.max())
        self.levels.append((radius, owner.copy()))
        while radius > self.LEAST and (near > 0).any() and self._gathers(np.flatnonzero(near > radius / 2), radius / 2):
            radius /= 2
            while len(left := np.flatnonzero(near > radius)):
                some = left[: self.STEP]
                far, ok, taken = self._far(some), np.ones(len(some), bool), []
                for i in range(len(some)):  # those that are apart from the ones taken before
                    if ok[i]:
                        taken.append(i)
                        ok &= far[i, some] > radius
                centres, far = some[taken], far[taken]
                far[np.arange(len(taken)), centres] = 0.0
                nearest = far.argmin(0)
                least = far[nearest, np.arange(len(near))]
                closer = least < near
                near[closer], owner[closer] = least[closer], centres[nearest[closer]]
            self.levels.append((radius, owner.copy()))

    def _gathers(self, left: np.ndarray, radius: float) -> bool:
        """Whether a level of this radius would bring rows together: not if most of a sample of the rows that it has to cover lie
        apart from one another. Then the tree ends here and its leaves are compared as they are."""
        some = left[:: max(1, len(left) // 256)][:256]
        far, ok, taken = self._far(some, some), np.ones(len(some), bool), 0
        for i in range(len(some)):
            if ok[i]:
                taken += 1
                ok &= far[i] > radius
        return len(some) < 64 or 2 * taken <= len(some)

    def _node(self, level: int, lo: int, hi: int) -> int:
        rows = self.order[lo:hi]
        while level + 1 < len(self.levels) and (self.group[level + 1][rows] == self.group[level + 1][rows[0]]).all():
            level += 1
        node, centre = len(self.centre), int(self.group[level][rows[0]])
        cover = float(self._far(centre, rows).max())
        for v, value in ((self.centre, centre), (self.cover, cover), (self.lo, lo), (self.hi, hi), (self.kids, None)):
            v.append(value)
        if hi - lo > self.LEAF and level + 1 < len(self.levels):
            own = self.group[level + 1][rows]
            cuts = [lo, *(lo + 1 + np.flatnonzero(own[1:] != own[:-1])).tolist(), hi]
            self.kids[node] = np.array([self._node(level + 1, i, j) for i, j in zip(cuts, cuts[1:])], np.int64)
        return node

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of all nodes; leaves stand for themselves."""
        return np.concatenate([np.array([i]) if self.kids[i] is None else self.kids[i] for i in nodes])

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]


def dual(a: CoverTree, b: CoverTree, reach: float, count: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of a, rows of b, and whether all these pairs link by their nodes' bounds; else the leaf pairs that no bound
    excludes. With a is b, nodes meet those that do not end before them, so each unordered pair comes up. Node pairs
    are taken from the roots down, siblings together; `count` adds up the distances that were computed."""
    same, step = a is b, 512
    todo = [(np.array([0]), np.array([0]))] if len(a.x) and len(b.x) else []
    while todo:
        one, two = todo.pop()
        if len(one) > step:
            todo += [(one[at : at + step], two) for at in range(0, len(one), step)]
            continue
        far = np.sqrt(np.maximum(2 - 2 * (a.x[a.centre[one]] @ b.x[b.centre[two]].T), 0))
        radii = a.cover[one][:, None] + b.cover[two]
        live = far <= radii + reach + SLACK
        if same:
            live &= b.hi[two] > a.lo[one][:, None]
        if count is not None:
            count[0] += far.size
        sure = live & (far + radii <= reach - 1e-6)
        if same:  # a node may only be settled as a whole against nodes that are apart from it, or itself
            sure &= (b.lo[two] >= a.hi[one][:, None]) | (two == one[:, None])
        for i, j in zip(*np.nonzero(sure)):
            yield a.rows(one[i]), b.rows(two[j]), True
        live &= ~sure
        for i in np.flatnonzero(live.any(1)):
            node, others = one[i], two[live[i]]
            ends = np.array([a.kids[node] is None and b.kids[j] is None for j in others])
            for j in others[ends]:
                if count is not None:
                    count[0] += int((a.hi[node] - a.lo[node]) * (b.hi[j] - b.lo[j]))
                rows = a.rows(node)
                for at in range(0, len(rows), step):
                    yield rows[at : at + step], b.rows(j), False
            if not ends.all():
                todo.append((a.below([node]), b.below(others[~ends])))


LINKS_DDL = "node binary, n long, least binary"


def _join_blocks(one: pa.Table, two: pa.Table | None, cosine: float, reach: float) -> pa.Table:
    """Links within a block, or between two: (node, vectors linked, a node that links lead to) per vector with any.

    `m` counts the equal vectors that a row stands for."""
    parts = [one] if two is None else [one, two]
    ids = np.array([x for p in parts for x in p.column("node").to_pylist()], object)
    m = np.concatenate([p.column("m").to_numpy() for p in parts])
    xa = unit(matrix(one.column("embedding"))) if len(one) else np.zeros((0, 1))
    xb = xa if two is None else unit(matrix(two.column("embedding"))) if len(two) else np.zeros((0, 1))
    ta = CoverTree(xa)
    tb, shift = (ta, 0) if two is None else (CoverTree(xb), len(xa))
    n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    place = np.empty(len(xa), np.int64)
    place[ta.order] = np.arange(len(xa))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(rows: np.ndarray, cols: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), cols.tolist()):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)

    for i, j, all_link in dual(ta, tb, reach):
        if all_link:
            within = two is None and i[0] == j[0] and len(i) == len(j)
            n[i] += m[j + shift].sum() - (m[i] if within else 0)
            if not within:
                n[j + shift] += m[i].sum()
            join(np.full(len(j), i[0]), j + shift)
            join(np.full(len(i), j[0] + shift), i)
            continue
        ok = xa[i] @ xb[j].T >= cosine
        if two is None:
            ok &= place[i][:, None] < place[j][None, :]
        r, c = np.nonzero(ok)
        if len(r):
            n += np.bincount(i[r], m[j[c] + shift], minlength=len(n)).astype(np.int64)
            n += np.bincount(j[c] + shift, m[i[r]], minlength=len(n)).astype(np.int64)
            join(i[r], j[c] + shift)
    hit = np.flatnonzero(n)
    top = np.array([find(i) for i in hit], np.int64)
    return pa.table({"node": pa.array(ids[hit].tolist(), pa.binary()), "n": pa.array(n[hit], pa.int64()), "least": pa.array(ids[top].tolist(), pa.binary())})


def links_of(good: DataFrame, cosine: float, centres: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, vec_id, embedding) of one dimension: (key, rep, m, n) of the distinct vectors, n being the vectors
    that link to another one than themselves, and the pairs (a, b) of ids that span the links."""
    reach = math.sqrt(max(2 - 2 * cosine, 0))
    classes = write_shared(good.groupBy("key").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count("*").alias("m")))
    # ids may repeat with other vectors, so vectors go by 128 bits of their key
    classes = classes.withColumn("node", F.unhex(F.substring("key", 1, 32)))
    # the sample of centres is bounded by `centres`
    want = max(1, min(centres, -(-classes.count() // cell)))
    tops = classes.orderBy("node", "key").limit(want).select("embedding").collect()
    middle = unit(np.array([r["embedding"] for r in tops], np.float64))

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (unit(x) @ middle.T), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = far(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["node", "embedding", "m", "cell", "away"])

    placed = write_shared(classes.select("node", "embedding", "m").mapInArrow(assign, "node binary, embedding array<double>, m long, cell int, away double"))
    radius, blocks = np.full(len(middle), -1.0), np.zeros(len(middle), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # one row per cell
        radius[r["cell"]], blocks[r["cell"]] = r["r"], -(-r["n"] // (2 * cell))
    first = np.concatenate([[0], np.cumsum(blocks)])  # a cell is dealt into blocks of about 2 x `cell` vectors
    of_block = np.repeat(np.arange(len(middle)), blocks)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                cells, salt = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                own = first[cells] + salt % blocks[cells]
                into = (far(matrix(batch.column(1))) <= radius + reach + SLACK)[:, of_block]
                into[np.arange(len(batch)), own] = True
                row, to = np.nonzero(into)
                lo, hi = np.minimum(own[row], to), np.maximum(own[row], to)
                taken = batch.select([0, 1, 2]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(own[row] == lo)], names=["node", "embedding", "m", "lo", "hi", "low"])

    def compare(t: pa.Table) -> pa.Table:
        if t.column("lo")[0] == t.column("hi")[0]:
            return _join_blocks(t, None, cosine, reach)
        low = t.column("low").to_numpy()
        return _join_blocks(t.filter(pa.array(low)), t.filter(pa.array(~low)), cosine, reach)

    salted = placed.select("node", "embedding", "m", "cell", F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("salt"))
    visits = salted.mapInArrow(visit, "node binary, embedding array<double>, m long, lo int, hi int, low boolean")
    found = write_shared(visits.groupBy("lo", "hi").applyInArrow(compare, LINKS_DDL))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    rep = classes.select(F.col("node").alias("at"), F.col("vec_id").alias("rep"))
    edges = found.where("node <> least").join(rep, F.col("node") == F.col("at")).select("least", F.col("rep").alias("a")).join(rep, F.col("least") == F.col("at")).select("a", F.col("rep").alias("b"))
    return classes.join(sums, "node", "left").select("key", F.col("vec_id").alias("rep"), "m", F.coalesce("n", F.lit(0)).alias("n")), edges


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, centres: int = CENTRES, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    # the key tells vectors of one dimension apart; equal vectors are one row that stands for m
    key = F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.sha2(F.to_json("embedding").cast("binary"), 256))
    rows = write_shared(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), key.alias("key"), F.size("embedding").alias("dim")))
    classes = edges = None
    for r in rows.where("key is not null").select("dim").distinct().orderBy("dim").collect():  # one row per dimension
        one, pairs = links_of(rows.where("key is not null").where(F.col("dim") == r["dim"]).select("key", "vec_id", "embedding"), cosine, centres, cell)
        classes, edges = (one, pairs) if classes is None else (classes.union(one), edges.union(pairs))
    if classes is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = rows.join(classes, "key", "left")
    # a row's id hangs on the id that stands for its vector
    own = known.where("rep <> vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    reachable = components(edges.union(own)).withColumnRenamed("id", "vec_id")
    out = known.select("vec_id", F.coalesce(F.col("n") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links")).join(reachable, "vec_id", "left")
    at = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "n_links", at.alias("component_id"), F.coalesce(at == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
r(a, b) as (select a, b from l), n as (select a, count(*) as n_links from l group by a),
c as (with recursive reach(a, b) as (select vec_id, vec_id from u union select reach.a, l.b from reach join l on l.a = reach.b) select a, min(b) as component_id from reach group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, coalesce(c.component_id, e.vec_id) as component_id, coalesce(c.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""
