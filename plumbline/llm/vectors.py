"""Embedding near-duplicates by NN-descent.

A neighbour graph is started from sorted random hyperplane codes and refined: the neighbours of a vector are compared
with each other, and each keeps the nearest it has met. Equal vectors are one class, a vector with a weight. Edges at
the threshold are links, and what they reach is a component. An exact check of every component follows, at any size:
components lie in balls, all balls are compared, and so are all vectors of those balls that could touch another. Links
inside components are counted in blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, runs
from .components import components

EDGES = "a long, b long, sim double"
PLANES = 24


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (id, space, v): those that can link, scaled to length 1 in double precision.
    Only vectors of one label and one length share a space."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    v = v.where("id is not null and label is not null and e is not null").where(sound & (F.size("e") > 0))
    # scaled by the largest component first, so that the sum of squares neither overflows nor vanishes
    v = v.withColumn("top", F.array_max(F.transform("e", lambda x: F.abs(x)))).where("top > 0")
    v = v.withColumn("e", F.transform("e", lambda x: x / F.col("top")))
    v = v.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    return v.select("id", F.xxhash64("label", F.size("e")).alias("space"), F.transform("e", lambda x: x / F.col("norm")).alias("v"))


def one_each(vectors: DataFrame) -> DataFrame:
    """One row for each id; of several the smallest by space and components, so that reruns agree."""
    return vectors.groupBy("id").agg(F.min(F.struct("space", "v")).alias("x")).select("id", "x.space", "x.v")


def classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """vectors (id, space, v) -> classes of equal vectors (id, space, v, weight), named by their smallest id, and the
    class of each vector (id, class)."""
    key = ["space", "h1", "h2"]
    hashed = vectors.select("id", "space", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(0x5EED), "v").alias("h2"))
    rows = scratch.keep(hashed.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")), "classes")
    # a written table on both sides, so that the partition of a frequent vector can be split
    of = scratch.keep(hashed.select("id", *key).join(rows.select(*key, F.col("id").alias("class")), key).select("id", "class"), "class-of")
    return rows.select("id", "space", "v", "weight"), of


def _planes(n: int, table: int) -> np.ndarray:
    return np.random.default_rng([n, table]).standard_normal((n, PLANES + 1))


def _code(m: np.ndarray, table: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits as a number, and one projection more for the order among equals."""
    x = m @ _planes(m.shape[1], table)
    return (x[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)), x[:, PLANES]


def first_graph(vectors: DataFrame, tables: int, bits: int, reach: int, partitions: int) -> DataFrame:
    """Edges to the next `reach` vectors in the order of (space, code, projection), for each of several codes."""
    schema = "t int, space long, code long, at double, id long, v array<double>"

    def coded(batches):
        for batch in batches:
            ids, spaces, vs = (batch.column(i) for i in range(3))
            groups: dict[int, list[int]] = {}
            for i, n in enumerate(np.diff(vs.offsets.to_numpy()).tolist()):
                groups.setdefault(n, []).append(i)
            for rows in groups.values():
                take = pa.array(rows)
                m = _matrix(vs.take(take))
                for t in range(tables):
                    code, at = _code(m, t, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), spaces.take(take), pa.array(code), pa.array(at), ids.take(take), vs.take(take)], names=["t", "space", "code", "at", "id", "v"])

    def near(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keep = min(reach, held.num_rows)
            yield from linked(held)
            held = held.slice(held.num_rows - keep)

    def linked(t):
        key = [t[c].combine_chunks().to_numpy() for c in ("t", "space", "code")]
        ids, vs = t["id"].combine_chunks().to_numpy(), t["v"].combine_chunks()
        lengths = np.diff(vs.offsets.to_numpy())
        flat, start = vs.flatten().to_numpy(), vs.offsets.to_numpy()[:-1] - vs.offsets.to_numpy()[0]
        for d in range(1, min(reach, len(ids) - 1) + 1):
            same = np.flatnonzero(np.logical_and.reduce([k[d:] == k[:-d] for k in key]) & (ids[d:] != ids[:-d]))
            for n in np.unique(lengths[same]).tolist():
                rows = same[lengths[same] == n]
                x, y = (flat[(start[r][:, None] + np.arange(n))] for r in (rows, rows + d))
                sim = np.einsum("ij,ij->i", x, y)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[rows + d]), pa.array(sim)], names=["a", "b", "sim"])

    order = ["t", "space", "code", "at", "id"]
    ranged = vectors.mapInArrow(coded, schema).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(near, EDGES)


def nearest(edges: DataFrame, k: int, partitions: int) -> DataFrame:
    """Both directions of distinct edges, the k nearest of each end."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def descend(vectors: DataFrame, graph: DataFrame, k: int, partitions: int) -> DataFrame:
    """One local join: around each vector, its neighbours and itself are compared; of each one the nearest few it met
    there become edges."""
    at = graph.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionAll(graph.select(F.col("a").alias("hub"), F.col("a").alias("id")).distinct())
    rows = at.join(vectors.select("id", "v"), "id").select("hub", "id", "v")
    few = min(k, 8)

    def join(batches):
        out: dict[tuple[int, int], float] = {}

        def flush():
            e = np.array(list(out), np.int64).reshape(-1, 2)
            b = pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.fromiter(out.values(), float, len(out)))], names=["a", "b", "sim"])
            out.clear()
            return b

        for t in runs(batches, ["hub"]):
            if t.num_rows < 2:
                continue
            ids = t["id"].combine_chunks().to_numpy()
            m = _matrix(t["v"])
            s = m @ m.T
            np.fill_diagonal(s, -2.0)
            n = min(few, len(ids) - 1)
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            for i, row in enumerate(best.tolist()):
                for j in row:
                    a, b = int(ids[i]), int(ids[j])
                    if a != b:
                        out[(a, b) if a < b else (b, a)] = s[i, j]
            if len(out) > 200_000:
                yield flush()
        if out:
            yield flush()

    return rows.repartition(partitions, "hub").sortWithinPartitions("hub").mapInArrow(join, EDGES)


def complete(vectors: DataFrame, clusters: DataFrame, threshold: float, scratch: Scratch, block: int = 1_024, one_task: int = 256) -> DataFrame:
    """vectors (id, v), clusters (node, component) -> (id, n_links): links of each member inside its component. Where
    vectors have a weight, a link counts as often as the weight of its other end.

    Components of more than one_task vectors are compared in pairs of blocks of `block` vectors at most; a task holds two
    blocks, and only counts leave it.
    """
    weight = F.col("weight") if "weight" in vectors.columns else F.lit(1).cast("long")
    members = scratch.keep(clusters.join(vectors.select(F.col("id").alias("node"), "v", weight.alias("weight")), "node"), "members")
    many = F.when(F.count("*") > one_task, F.ceil(F.sqrt(F.count("*")) / 3)).otherwise(1)
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), many).cast("int").alias("blocks")).where("blocks > 1").hint("rebalance")
    cut = members.join(sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = cut.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "v", "weight")

    def run(batches):
        for t in runs(batches, ["component", "i", "j"]):
            own, ids, m = t["own"].combine_chunks().to_numpy(), t["node"].combine_chunks().to_numpy(), _matrix(t["v"])
            weights = t["weight"].combine_chunks().to_numpy()
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(x) or not len(y):
                continue
            near = m[x] @ m[y].T >= threshold
            near &= ids[x][:, None] != ids[y][None, :]
            counts = [(ids[x], near @ weights[y])] + ([(ids[y], weights[x] @ near)] if i != j else [])
            for who, n in counts:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], names=["id", "n"])

    counted = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def _pairwise(rows: DataFrame, threshold: float, scratch: Scratch, meet, schema: str, at_once: int, block: int) -> DataFrame:
    """Every two rows (id, space, v, component, reach) of one space meet in a tile; written rows of what meet gives.

    A part of about at_once rows is broadcast and meets itself and the parts after it in a scan, so nothing is shuffled.
    meet(held, tiles) begins a task's work on a part, a table, and returns what is called for each of its batches.
    tiles(batch) gives for each tile the places of its rows in the part and in the batch, both matrices, and which pairs
    may be near: a single-precision bound that passes every pair whose angle is at most that of the threshold and both
    reaches.
    """
    columns = ["id", "space", "v", "component", "reach"]
    parts = max(1, -(-rows.count() // at_once))
    dealt = scratch.keep(rows.select(*columns, F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(parts)).alias("q")), "asking")
    half = float(np.arccos(np.clip(threshold, -1.0, 1.0))) / 2

    def widened(m: np.ndarray, reach: np.ndarray, sign: float) -> np.ndarray:
        # x.y - cos(s + t) is a product of two vectors, as cos(s + t) = cos s cos t - sin s sin t; from a right angle on
        # nothing is ruled out
        s, out = reach + half, np.empty((len(m), m.shape[1] + 2), np.float32)
        wide = s >= np.pi / 2
        out[:, :-2], out[:, -2], out[:, -1] = m, sign * np.cos(s), np.sin(s)
        out[wide] = 0.0
        out[wide, -1] = 1.0
        return out

    def run_on(held):
        def run(batches):
            t = held.value
            if not t.num_rows:
                return
            spaces, reach, vs = t["space"].to_numpy(), t["reach"].to_numpy(), t["v"].combine_chunks()
            index: dict[int, list] = {}
            for s in np.unique(spaces).tolist():
                at = np.flatnonzero(spaces == s)
                for i in (at[k : k + block] for k in range(0, len(at), block)):
                    m = _matrix(vs.take(pa.array(i)))
                    index.setdefault(s, []).append((i, m, widened(m, reach[i], -1.0)))

            def tiles(batch):
                space, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 4))
                for s in np.unique(space).tolist():
                    if s not in index:
                        continue
                    at = np.flatnonzero(space == s)
                    w = _matrix(batch.column(2).take(pa.array(at)))
                    # single precision errs by less than this
                    w32, slack = widened(w, far[at], 1.0).T, -np.float32((w.shape[1] + 8) * 2.0**-22)
                    for i, m, m32 in index[s]:
                        may = m32 @ w32 >= slack
                        if may.any():
                            yield i, at, m, w, may

            batched, end = meet(t, tiles)
            for batch in batches:
                yield from batched(batch)
            yield from end()

        return run

    out = []
    for q in range(parts):
        held = rows.sparkSession.sparkContext.broadcast(dealt.where(F.col("q") == q).select(*columns).toArrow())
        out.append(scratch.keep(dealt.where(F.col("q") >= q).select(*columns).mapInArrow(run_on(held), schema), "met"))
        held.destroy()
    return reduce(DataFrame.unionAll, out)


def joining(rows: DataFrame, threshold: float, scratch: Scratch, at_once: int = 16_000, block: int = 2_000) -> DataFrame:
    """rows (id, space, v, component, reach) -> written (a, b, sim): links between different components, by comparing all
    rows of a space. Of the links between two components in a tile one is given."""

    def meet(held, tiles):
        ids, groups = held["id"].to_numpy(), held["component"].to_numpy()

        def batched(batch):
            own, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3))
            for i, at, m, w, may in tiles(batch):
                may &= groups[i][:, None] != group[at][None, :]
                x, y = np.nonzero(may)
                if not len(x):
                    continue
                sim = (m @ w.T)[x, y] if len(x) * 64 > may.size else np.einsum("ij,ij->i", m[x], w[y])
                x, y, sim = (c[sim >= threshold] for c in (x, y, sim))
                if not len(x):
                    continue
                _, one = np.unique(np.stack([groups[i][x], group[at][y]], 1), axis=0, return_index=True)
                x, y, sim = x[one], y[one], sim[one]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][x]), pa.array(own[at][y]), pa.array(sim)], names=["a", "b", "sim"])

        return batched, lambda: ()

    return _pairwise(rows, threshold, scratch, meet, EDGES, at_once, block)


def touched(balls: DataFrame, threshold: float, scratch: Scratch, at_once: int = 16_000, block: int = 2_000) -> DataFrame:
    """balls (id, space, v, component, reach) -> component: those that another one is near enough to for a link."""

    def meet(held, tiles):
        groups = held["component"].to_numpy()
        found = np.zeros(len(groups), bool)

        def batched(batch):
            group = batch.column(3).to_numpy(zero_copy_only=False)
            some = np.zeros(len(group), bool)
            for i, at, _, _, may in tiles(batch):
                may &= groups[i][:, None] != group[at][None, :]
                found[i] |= may.any(axis=1)
                some[at] |= may.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(group[some])], names=["component"])

        def end():
            yield pa.RecordBatch.from_arrays([pa.array(groups[found])], names=["component"])

        return batched, end

    return _pairwise(balls, threshold, scratch, meet, "component long", at_once, block).distinct()


def across(vectors: DataFrame, clusters: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """vectors (id, space, v), clusters (node, component) -> links (a, b, sim) between components, at least one for any
    two that have some; vectors without a component are one of their own.

    A component is a ball around its smallest vector. Two linked vectors of different components lie in balls that touch
    within the threshold's angle, so only vectors of such balls are compared. That is quadratic in the components of a
    space, and in the vectors of those that touch.
    """
    at = vectors.select("id", "space", "v").join(clusters, F.col("id") == F.col("node"), "left")
    members = scratch.keep(at.select("id", "space", "v", F.coalesce("component", "id").alias("component"), F.lit(0.0).alias("reach")), "placed")
    centres = members.where("id = component").select("component", F.col("v").alias("c"))
    cosine = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # only those that are not alone have a radius
    radius = members.where("id <> component").join(centres, "component").groupBy("component").agg(F.acos(F.least(F.greatest(F.min(cosine), F.lit(-1.0)), F.lit(1.0))).alias("far"))
    balls = members.where("id = component").drop("reach").join(radius, "component", "left")
    balls = scratch.keep(balls.select("id", "space", "v", "component", (F.coalesce("far", F.lit(0.0)) + 1e-6).alias("reach")), "balls")
    near = scratch.keep(members.join(touched(balls, threshold, scratch), "component", "left_semi").select(*members.columns), "touching")
    return joining(near, threshold, scratch)


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, k: int = 10, tables: int = 8, reach: int = 3, most_rounds: int = 8, every: int = 20, least_recall: float = 0.999, attempts: int = 3, fewest: int = 20_000) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Two vectors of equal label are linked if their cosine in double precision is at least the threshold; a component
    is what links reach, and kept marks its smallest vec_id. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing and are kept. Vectors of different lengths do
    not link. Rows that share a vec_id are one vector, the smallest of those that can link; rows without vec_id have no links and a null component. An empty
    table gives no rows; other columns are ignored. No link is lost at any size: what NN-descent missed the check of all
    components adds, so k, tables, reach and most_rounds change the time only. every, least_recall, attempts and fewest
    belonged to an audit of a part, which that check has replaced; they are taken from older callers and have no effect.
    """
    usable_rows, class_of = classes(scratch.keep(one_each(usable(vectors)), "vectors"), scratch)
    n = usable_rows.count()
    partitions = max(8, n // 20_000)
    spaces = usable_rows.groupBy("space").count().agg(F.max("count")).first()[0] or 1
    bits = int(min(PLANES, max(2, np.log2(max(spaces, 8) / 6))))
    graph = scratch.keep(nearest(first_graph(usable_rows, tables, bits, reach, partitions), k, partitions), "graph")
    links = F.col("sim") >= threshold

    def per_vector(edges: DataFrame) -> DataFrame:
        return edges.where(links).groupBy("a").agg(F.count("*").alias("n"))

    for _ in range(most_rounds):
        new = nearest(graph.unionAll(descend(usable_rows, graph, k, partitions)), k, partitions)
        old, graph = graph, scratch.keep(new, "graph")
        # lists full of links only trade members of their component
        gained = per_vector(graph).join(per_vector(old).withColumnRenamed("n", "had"), "a", "left").where(F.col("n") > F.coalesce("had", F.lit(0))).count()
        scratch.drop(old)
        if gained <= n // 10_000:
            break
    edges = scratch.keep(graph.where(links), "links")
    clusters = scratch.keep(components(edges.select("a", "b"), scratch), "clusters")
    found = across(usable_rows, clusters, threshold, scratch)
    if found.count():
        clusters = scratch.keep(components(edges.unionAll(found).select("a", "b"), scratch), "clusters")
    counts = scratch.keep(complete(usable_rows, clusters, threshold, scratch), "counts")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    by_class = usable_rows.select(F.col("id").alias("class"), "weight").join(counts.withColumnRenamed("id", "class"), "class", "left").join(clusters.withColumnRenamed("node", "class"), "class", "left")
    by_class = by_class.select("class", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    named = class_of.join(scratch.keep(by_class, "by-class"), "class").select("id", "n_links", "component")
    out = ids.join(named, F.col("vec_id") == F.col("id"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
