"""MinHash near-duplicates with b-bit signatures.

1. Each text becomes the set of its word shingles, a signature of low bits of minima, and band keys of whole minima.
   Texts of equal sets are one class from here on, whose smallest doc_id stands for it.
2. Classes that share a band key are candidates. Their similarity is estimated by counting equal b-bit values,
   corrected for chance collisions. Inside a bucket only the edges of a spanning forest of plausible pairs are emitted,
   never all pairs.
3. Candidate clusters (components of that forest) are confirmed on full sets, again as a spanning forest: each pair in
   a cluster is either compared exactly or already known to be connected. In a large cluster a few members look at all,
   then those that this leaves outside the main tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, maybe_in, pieces, release, runs, strings
from .components import components
from .text import SPACE, mix, shingles, words

#: 48 bands of 5 minima: a pair at similarity 0.8 shares no band with a chance of 5e-9.
BANDS, ROWS, LOW_BITS = 48, 5, 2
MINIMA = BANDS * ROWS
SLOTS = 64 // LOW_BITS
LONGS = -(-MINIMA // SLOTS)
PADDING = LONGS * SLOTS - MINIMA
_ODD = np.uint64(0x5555555555555555)


def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:MINIMA], low[MINIMA:] | np.uint32(1)


def minima(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One row for each set, which must not be empty."""
    flip, factor = _family()
    h = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(ptr) - 1, MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat((h ^ flip[k]) * factor[k], ptr[:-1])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    part = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key


def signature(m: np.ndarray) -> np.ndarray:
    low = np.zeros((len(m), LONGS * SLOTS), np.uint64)
    low[:, :MINIMA] = m & np.uint32((1 << LOW_BITS) - 1)
    low = low.reshape(len(m), LONGS, SLOTS) << (np.arange(SLOTS, dtype=np.uint64) * np.uint64(LOW_BITS))
    return np.bitwise_or.reduce(low, axis=2)


def equal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal b-bit values of signatures in the last axis; both broadcast."""
    d = a ^ b
    return MINIMA - np.bitwise_count((d | d >> np.uint64(1)) & _ODD).sum(axis=-1, dtype=np.int64)


def similarity(slots: np.ndarray) -> np.ndarray:
    """Two values agree by chance once in 2^b, which is taken out."""
    chance = 1 / (1 << LOW_BITS)
    return (slots / MINIMA - chance) / (1 - chance)


def least_slots(threshold: float, deviations: float = 5.0) -> int:
    """A pair at the threshold has fewer equal values with a chance of 3e-7."""
    p = 0.25 + 0.75 * threshold
    return int(np.floor(MINIMA * p - deviations * np.sqrt(MINIMA * p * (1 - p))))


SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, bands binary, sig binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) -> one row each. h1 and h2 are a 128-bit hash of the set; null where it is empty."""

    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            parts = []
            for a, b in pieces(offsets, 2 << 20):
                sets, ptr = shingles(words(data, offsets[a : b + 1], SPACE), k)
                n = np.diff(ptr)
                some = np.flatnonzero(n)
                bands, sig = [None] * (b - a), [None] * (b - a)
                h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(some):
                    at = ptr[:-1][some]
                    m = minima(sets, np.append(at, len(sets)))
                    keys, low = band_keys(m), signature(m)
                    for i, t in enumerate(some.tolist()):
                        bands[t], sig[t] = keys[i].tobytes(), low[i].tobytes()
                    h1[some] = np.add.reduceat(mix(sets), at)
                    h2[some] = np.add.reduceat(mix(sets ^ np.uint64(0x243F6A8885A308D3)), at)
                none = n == 0
                parts.append((n, pa.array(h1.view(np.int64), mask=none), pa.array(h2.view(np.int64), mask=none), bands, sig))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.concatenate([p[0] for p in parts]), pa.int64()),
                        pa.concat_arrays([p[1] for p in parts]),
                        pa.concat_arrays([p[2] for p in parts]),
                        pa.array([x for p in parts for x in p[3]], pa.binary()),
                        pa.array([x for p in parts for x in p[4]], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )
            parts.clear()
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _explode_bands(batches):
    for batch in batches:
        node, sent = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        keys = np.frombuffer(b"".join(sent.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(keys)], names=["node", "band"])


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(n: int, linked_to) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0 to n - 1 in which linked_to(i) says for each j whether it is linked to i.

    A few members look at all others; the largest tree that gives is the main one. Then everyone looks who is outside
    it when their turn comes. Of two linked members either one has looked, or both were in the main tree: so the trees
    are the components, at the cost of one look for each member outside the main tree.
    """
    edges, forest, looked = [], Forest(n), set()

    def look(i: int) -> None:
        looked.add(i)
        for j in np.flatnonzero(linked_to(i)).tolist():
            if forest.join(i, j):
                edges.append((i, j))

    for i in range(0, n, max(1, n // 8)):
        look(i)
    roots = [forest.root(i) for i in range(n)]
    main = max(set(roots), key=roots.count) if n < 64 else int(np.bincount(roots).argmax())
    for i in range(n):
        if i not in looked and forest.root(i) != forest.root(main):
            look(i)
    return edges


def _bucket_edges(least: int):
    """Rows (band, node, sig) sorted by band -> the spanning forest of each bucket."""

    def done(band, node, sig):
        begin = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(begin, len(band)))
        two = begin[size == 2]
        near = two[equal_slots(sig[two], sig[two + 1]) >= least]
        a, b = [node[near]], [node[near + 1]]
        for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            own = sig[s : s + n]
            edges = spanning(n, lambda i: equal_slots(own, own[i]) >= least)
            if edges:
                e = np.array(edges) + s
                a.append(node[e[:, 0]])
                b.append(node[e[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] + [np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, LONGS)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if cut:
                yield done(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield done(*held)

    return run


EDGES = "a long, b long"
ALL, MEMBER, LOOKER = 0, 1, 2


def _same_text(k: int, percent: int):
    """Texts of a unit -> for row i the rows whose shingle sets are near enough to its own; empty sets are near none."""

    def make(t: pa.Table):
        data, offsets = strings(t["body"])
        sets, ptr = shingles(words(data, offsets, SPACE), k)
        size = np.diff(ptr)
        some = np.flatnonzero(size)
        at = ptr[:-1][some]
        # shingles as places in the unit's own list, so that a set is a mask
        _, place = np.unique(sets, return_inverse=True)
        mask = np.zeros(len(sets) + 1, bool)

        def linked_to(i: int) -> np.ndarray:
            out = np.zeros(len(size), bool)
            if size[i]:
                own = place[ptr[i] : ptr[i + 1]]
                mask[own] = True
                both = np.add.reduceat(mask[place], at, dtype=np.int64)
                mask[own] = False
                out[some] = 100 * both >= percent * (size[some] + len(own) - both)
            return out

        return linked_to

    return make


def _same_signature(least: int):
    def make(t: pa.Table):
        sig = np.frombuffer(b"".join(t["body"].to_pylist()), np.uint64).reshape(-1, LONGS)
        return lambda i: equal_slots(sig, sig[i]) >= least

    return make


def _unit_edges(make):
    """Units sorted by (g, lot, block) -> edges: a spanning forest of the whole unit, or of what its lookers see."""

    def run(batches):
        for t in runs(batches, ["g", "lot", "block"]):
            node, kind = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", "kind"))
            if len(node) < 2 or (kind == MEMBER).all():
                continue
            linked_to = make(t)
            if kind[0] == ALL:
                edges = spanning(len(node), linked_to)
            else:
                forest, edges = Forest(len(node)), []
                for i in np.flatnonzero(kind == LOOKER).tolist():
                    edges += [(i, j) for j in np.flatnonzero(linked_to(i)).tolist() if forest.join(i, j)]
            del linked_to
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]])], names=["a", "b"])
            release()

    return run


def linked_in_groups(members: DataFrame, make, scratch: Scratch, block_bytes: int, block_rows: int, first: int = 16, at_once: int = 256) -> DataFrame:
    """members (g, node, body), written -> edges that connect what links inside groups connect.

    A group of up to block_bytes and block_rows is one unit of work. Of a larger one, cut into blocks, about `first`
    members look at all others; the largest tree that gives is the main one. Then everyone outside it looks at all
    members. Of two linked members one has looked, or both are in the main tree, so no link is lost. A member is sent to
    one unit for every at_once lookers, once where nearly all are near each other, and never to all pairs of blocks.
    """
    unit = ["g", "lot", "block"]
    zero = F.lit(0).cast("long")

    def edges_of(units: DataFrame) -> DataFrame:
        dealt = units.select(*unit, "node", "body", "kind").repartition(*unit).sortWithinPartitions(*unit)
        return scratch.keep(dealt.mapInArrow(_unit_edges(make), EDGES).where("a <> b"), "unit-edges")

    size = F.octet_length("body") if dict(members.dtypes)["body"] == "string" else F.length("body")
    blocks = F.greatest(F.ceil(F.sum(size) / block_bytes), F.ceil(F.count("*") / block_rows))
    sizes = scratch.keep(members.groupBy("g").agg(F.count("*").alias("n"), blocks.cast("long").alias("blocks")).where("blocks > 1"), "large")
    large = members.join(sizes.hint("rebalance"), "g", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    edges = edges_of(large.where("blocks is null").withColumns({"lot": zero, "block": zero, "kind": F.lit(ALL)}))
    if sizes.isEmpty():
        return edges
    large = scratch.keep(large.where("blocks is not null"), "large-members")

    def looks(lookers: DataFrame, lots: DataFrame) -> DataFrame:
        """lookers (g, node), lots (g, lots): the edges of what they see among all members of their groups."""
        of = lookers.join(lots, "g").withColumn("lot", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("lots"))).select("g", "node", "lot")
        theirs = large.join(of, ["g", "node"]).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("kind", F.lit(LOOKER))
        others = large.join(lots, "g").withColumn("lot", F.explode(F.sequence(zero, F.col("lots") - 1))).withColumn("kind", F.lit(MEMBER))
        return edges_of(theirs.select(*unit, "node", "body", "kind").unionAll(others.select(*unit, "node", "body", "kind")))

    step = F.greatest(F.ceil(F.col("n") / first), F.lit(1))
    chosen = scratch.keep(large.where(F.pmod(F.xxhash64(F.lit(5), "node"), step) == 0).select("g", "node").distinct(), "lookers")
    seen = looks(chosen, sizes.select("g", F.lit(1).cast("long").alias("lots")))
    trees = components(seen, scratch)
    placed = scratch.keep(large.select("g", "node").distinct().join(trees, "node", "left"), "placed")
    main = placed.where("component is not null").groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"))
    outside = placed.join(main.hint("rebalance"), "g", "left").where("main is null or component is null or component <> main").select("g", "node")
    outside = scratch.keep(outside.join(chosen, ["g", "node"], "left_anti"), "outside")
    if outside.isEmpty():
        return edges.unionAll(seen)
    lots = outside.groupBy("g").agg(F.ceil(F.count("*") / at_once).cast("long").alias("lots"))
    return edges.unionAll(seen).unionAll(looks(outside, scratch.keep(lots, "lots")))


def candidate_edges(reps: DataFrame, scratch: Scratch, least: int, most: int = 4_000) -> DataFrame:
    """reps (node, bands, sig) -> edges (a, b) that connect what plausible pairs inside buckets connect.

    Buckets of up to `most` members are looked at in one task each, larger ones in blocks. No bucket is cut, and none
    is gathered whole in a task.
    """
    rows = reps.select("node", "bands").mapInArrow(_explode_bands, "node long, band long")
    shared = scratch.keep(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = rows.join(shared, "band").select("band", "n", "node")
    members = members.join(reps.select("node", "sig"), "node").select("band", "n", "node", "sig")
    members = scratch.keep(members, "members")
    small = members.where(F.col("n") <= most).select("band", "node", "sig").repartition("band").sortWithinPartitions("band")
    edges = small.mapInArrow(_bucket_edges(least), EDGES)
    if shared.where(F.col("n") > most).isEmpty():
        return edges
    large = scratch.keep(members.where(F.col("n") > most).select(F.col("band").alias("g"), "node", F.col("sig").alias("body")), "large-buckets")
    return edges.unionAll(linked_in_groups(large, _same_signature(least), scratch, 1 << 40, most))


def confirmed_edges(docs: DataFrame, clusters: DataFrame, scratch: Scratch, k: int, percent: int, block_bytes: int = 8 << 20, one_task: int = 512) -> DataFrame:
    """docs (doc_id, text), clusters (node, component) -> edges that connect what pairs of at least percent connect.

    Texts are shuffled to their clusters after a bitmap of bounded size has let most of the others go.
    """
    clusters = scratch.keep(clusters, "clusters")
    texts = maybe_in(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node", clusters, "node").where("__maybe").drop("__maybe")
    texts = scratch.keep(texts.join(clusters, "node").select(F.col("component").alias("g"), "node", F.coalesce("text", F.lit("")).alias("body")), "texts")
    return linked_in_groups(texts, _same_text(k, percent), scratch, block_bytes, one_task)


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of k-word shingles have 100 * intersection >= percent * union; a component is
    what links reach; kept marks its smallest doc_id. A text of fewer than k words has its word sequence as its one
    shingle; null texts and texts without words have none, are linked with nothing and kept. Repeated rows come back
    each with the same values; rows that share a doc_id are one document. Rows without a doc_id are kept, with a null
    component. An empty table gives no rows; other columns are ignored; texts are read whole.
    """
    found = scratch.keep(sketches(docs, k), "sketches")
    real = found.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    reps = real.join(classes.withColumnRenamed("node", "doc_id"), ["h1", "h2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "bands", "sig")
    reps = scratch.keep(reps.dropDuplicates(["node"]), "reps")
    clusters = components(candidate_edges(reps, scratch, least_slots(percent / 100)), scratch)
    edges = confirmed_edges(docs, clusters, scratch, k, percent)
    # rows of one doc_id with different sets are one document
    several = real.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y")
    twins = real.join(several.select("doc_id"), "doc_id").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linked = components(edges.unionAll(twins.distinct()), scratch)
    named = classes.join(linked, "node", "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "node").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "h1", "h2").join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
