"""Embedding near-duplicates: all pairs with cosine >= 0.9 by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c). The top of the tree is a bounded
number of pivots drawn from the table; each vector goes to its nearest pivot's cell, and cells
are cut into blocks that fit in a task. Within a block nested levels with halving radii (1, 1/2,
1/4) are built once: the centres of a level are a part of the next level's. Pairs of blocks are
compared by dual traversal: from level to level a pair of nodes is dropped when the distance of
their centres exceeds both covering radii plus the threshold's distance. What is left is
compared vector by vector; cosines too near the threshold for single precision are computed in
double precision, so the pairs are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable, read, small_batches
from .components import components
from .forest import forest

MIN_COSINE = 0.9
RADII = (1.0, 0.5, 0.25)
#: Vectors in a block, pivots at most, blocks at most (beyond it, blocks grow with the table).
BLOCK, PIVOTS, BLOCKS = 4096, 256, 1024
#: Rows multiplied at once.
ROWS = 2048
#: Single-precision cosines this near the threshold are computed again in double precision.
BAND = 1e-4
_SLACK = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def levels(unit: np.ndarray) -> np.ndarray:
    """For every vector its centre at each level (column k: radius RADII[k]); nested."""
    n = len(unit)
    out = np.empty((n, len(RADII)), np.int32)
    groups = [np.arange(n)]
    for k, radius in enumerate(RADII):
        made = []
        for left in groups:
            while len(left):
                near = _distance(unit[left[:1]], unit[left])[0] <= radius
                near[0] = True
                out[left[near], k] = left[0]
                made.append(left[near])
                left = left[~near]
        groups = made
    return out


class Tree:
    """The nodes of a block's levels: members by centre, tight covering radii."""

    def __init__(self, unit: np.ndarray, path: np.ndarray):
        self.unit, self.at = unit, []
        for k in range(path.shape[1]):
            centres, of = np.unique(path[:, k], return_inverse=True)
            gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit, unit[path[:, k]])))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, of, gap)
            self.at.append((centres, of, radius))


def _near(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, far: float) -> np.ndarray:
    """Which centres are no further apart than both radii plus `far`. A distance of d is a dot
    product of 1 - d^2 / 2, so single vectors, most nodes, take one product and one comparison."""
    dot = a @ b.T
    least = lambda d: (1 - d * d / 2 - 2e-6).astype(np.float32)
    out = dot >= least(np.float64(far + _SLACK))
    for i in np.array_split(np.flatnonzero(ra), 1 + np.count_nonzero(ra) // 512):
        out[i] = dot[i] >= least(ra[i][:, None] + rb[None, :] + far + _SLACK)
    for j in np.array_split(np.flatnonzero(rb), 1 + np.count_nonzero(rb) // 512):
        out[:, j] = dot[:, j] >= least(ra[:, None] + rb[j][None, :] + far + _SLACK)
    return out


def _pairs(a: Tree, b: Tree, far: float):
    """Dual traversal: (rows of a, rows of b, mask of the pairs that may be near), in slabs."""
    rows, cols = np.arange(len(a.unit)), np.arange(len(b.unit))
    keep, ka, kb = None, None, None
    for (ca, oa, ra), (cb, ob, rb) in zip(a.at, b.at, strict=True):
        if keep is None:
            keep = _near(a.unit[ca], ra, b.unit[cb], rb, far)
        else:  # children of pairs that are left
            pa_, pb_ = np.flatnonzero(keep.any(axis=1)[ka[ca]]), np.flatnonzero(keep.any(axis=0)[kb[cb]])
            part = _near(a.unit[ca[pa_]], ra[pa_], b.unit[cb[pb_]], rb[pb_], far) & keep[np.ix_(ka[ca[pa_]], kb[cb[pb_]])]
            keep = np.zeros((len(ca), len(cb)), bool)
            keep[np.ix_(pa_, pb_)] = part
        if not keep.any():
            return
        ka, kb = oa, ob
    rows, cols = rows[keep.any(axis=1)[ka]], cols[keep.any(axis=0)[kb]]
    for k in range(0, len(rows), ROWS):
        own = rows[k : k + ROWS]
        for m in range(0, len(cols), ROWS):
            other = cols[m : m + ROWS]
            yield own, other, keep[np.ix_(ka[own], kb[other])]


def _linked(a: Tree, b: Tree, xa: np.ndarray, xb: np.ndarray, least: float):
    """(rows, cols, matrix of links) over the traversal's slabs; xa and xb in double precision."""
    for own, other, mask in _pairs(a, b, math.sqrt(2 - 2 * least)):
        cosine = a.unit[own] @ b.unit[other].T
        link = mask & (cosine >= least + BAND)
        i, j = np.nonzero(mask & (np.abs(cosine - least) < BAND))
        for k in range(0, len(i), 1 << 16):
            p, q = xa[own[i[k : k + (1 << 16)]]], xb[other[j[k : k + (1 << 16)]]]
            exact = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
            link[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = exact >= least
        yield own, other, link


def _compare(table: pa.Table, least: float) -> pa.Table:
    """A task's one or two blocks -> (a, b, links): rows with links count a's, rows with b are spanning links."""
    block = table.column("block").to_numpy()
    sides = []
    for name in np.unique(block):
        own = table.filter(pa.array(block == name))
        order = np.argsort(own.column("place").to_numpy())
        x = _matrix(own.column("vec"))[order]
        path = np.stack([own.column(f"c{k}").to_numpy()[order] for k in range(len(RADII))], axis=1)
        sides.append((own.column("key").to_numpy()[order], own.column("n").to_numpy()[order], x, Tree(_unit(x), path)))
    (ka, na, xa, ta), (kb, nb, xb, tb) = sides[0], sides[-1]
    same = len(sides) == 1
    out_a, out_b, out_n = [], [], []
    got_a, got_b, edges = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64), []
    for own, other, link in _linked(ta, tb, xa, xb, least):
        if same:
            link &= own[:, None] != other[None, :]
        if not link.any():
            continue
        got_a[own] += link @ nb[other]
        if not same:
            got_b[other] += link.T @ na[own]
        i, j = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        part = link[np.ix_(i, j)]
        if part.sum() <= 2 * (len(i) + len(j)):
            p, q = np.nonzero(part)
            edges.append((ka[own[i[p]]], kb[other[j[q]]]))
        else:  # a dense slab: only links that span it

            def near(x, others, part=part, r=len(i)):
                return np.where(others >= r, part[x, np.maximum(others - r, 0)], False) if x < r else np.where(others < r, part[np.minimum(others, r - 1), x - r], False)

            names = np.append(ka[own[i]], kb[other[j]])
            for x, found in forest(len(names), near):
                edges.append((np.full(len(found), names[x]), names[found]))
    for keys, got in ((ka, got_a), (kb, got_b)):
        hit = np.flatnonzero(got)
        out_a.append(keys[hit])
        out_b.append(np.full(len(hit), -1))
        out_n.append(got[hit])
    for p, q in edges:
        out_a.append(p)
        out_b.append(q)
        out_n.append(np.zeros(len(p), np.int64))
    a, b, n = (np.concatenate(v).astype(np.int64) for v in (out_a, out_b, out_n))
    return pa.table({"a": pa.array(a), "b": pa.array(b, mask=b < 0), "links": pa.array(n)})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors; other columns are not read.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null id, link with nothing: 0 links, and the row is its own component. Vectors of different
    lengths don't link. Rows with equal vectors link with each other and are compared once.
    Ids need not be unique: each row counts. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumn("fine", fine)
    groups = rows.where("fine").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    held = durable(groups.withColumn("key", F.monotonically_increasing_id()), "vectors")  # written once: the keys stay
    total = held.count()
    pivots = held.orderBy(F.xxhash64("key")).limit(max(1, min(PIVOTS, -(-total // BLOCK)))).select("vec").collect()
    by_length: dict[int, list] = {}
    for k, r in enumerate(pivots):
        by_length.setdefault(len(r.vec), []).append((k, r.vec))
    tops = {d: (np.array([k for k, _ in own]), _unit(np.array([x for _, x in own]))) for d, own in by_length.items()}
    size = max(BLOCK, -(-total // BLOCKS))

    def assign(batches):
        for b in batches:
            vec = b.column(b.schema.get_field_index("vec"))
            length = np.diff(np.asarray(vec.offsets)) if len(b) else np.empty(0, int)
            cell, gap = np.zeros(len(b), np.int64), np.zeros(len(b))
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                if int(d) not in tops:  # a length without a pivot is a cell of its own
                    cell[own], gap[own] = -int(d), 2.0
                    continue
                names, top = tops[int(d)]
                away = _distance(_unit(_matrix(vec.take(pa.array(own)))), top)
                cell[own], gap[own] = names[away.argmin(axis=1)], away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(gap)], [*b.schema.names, "cell", "gap"])

    celled = held.mapInArrow(assign, StructType(list(held.schema)).add("cell", "long").add("gap", "double"))
    stats = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    first, blocks = {}, []
    for s in sorted(stats, key=lambda s: s.cell):
        first[s.cell] = (len(blocks), -(-s.n // size))
        blocks += [s] * first[s.cell][1]
    far, deal = math.sqrt(2 - 2 * least), []
    where = {k: x for names, top in tops.values() for k, x in zip(names, top, strict=True)}
    for i, p in enumerate(blocks):
        for j in range(i, len(blocks)):
            q = blocks[j]
            x, y = where.get(p.cell), where.get(q.cell)
            if p.cell != q.cell and (x is None or y is None or len(x) != len(y) or _distance(x[None], y[None])[0, 0] > p.radius + q.radius + far + _SLACK):
                continue
            deal += [(i, i * len(blocks) + j)] + [(j, i * len(blocks) + j)] * (i != j)
    starts = spark.createDataFrame([(c, a, b) for c, (a, b) in first.items()], "cell long, start long, parts long")
    dealt = celled.join(F.broadcast(starts), "cell").select("key", "n", "vec", (F.col("start") + F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block"))

    def built(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("key").to_numpy())))
        path = levels(_unit(_matrix(table.column("vec"))))
        for k in range(len(RADII)):
            table = table.append_column(f"c{k}", pa.array(path[:, k]))
        return table.append_column("place", pa.array(np.arange(len(table), dtype=np.int32)))

    schema = StructType(list(dealt.schema))
    for k in range(len(RADII)):
        schema = schema.add(f"c{k}", "integer")
    trees = durable(dealt.groupBy("block").applyInArrow(built, schema.add("place", "integer")), "vector-trees")
    tasks = spark.createDataFrame(deal, "block long, task long")
    found = trees.join(tasks, "block").groupBy("task").applyInArrow(lambda t: _compare(t, least), "a long, b long, links long")
    found = durable(found, "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), "vector-cc")
    named = held.join(counts, held.key == counts.a, "left").join(roots, held.key == roots.node, "left")
    named = named.select("vec", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(named.join(label, "root").select("vec", "n_links", "component_id"), "vector-labels")
    linked = rows.where("fine").join(named, "vec").select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP8_SQL = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id, vec_id as reach from v union select r.vec_id, p.b from r join p on r.reach = p.a),
c as (select vec_id, min(reach) m from r group by 1), n as (select a, count(*) k from p group by 1)
select e.vec_id, coalesce(k, 0)::bigint as n_links, coalesce(m, e.vec_id) as component_id, coalesce(m, e.vec_id) = e.vec_id as kept
from embeddings e left join c on c.vec_id = e.vec_id left join n on n.a = e.vec_id
"""
