"""Language-model scoring by a weighted backoff automaton that no machine holds whole.

Smoothed n-grams become the automaton. Its states are the contexts seen in training, from the root (no word) over single
words to strings of order - 1 words, and one chain of states for the start of a text. An arc leads from a context over a
word that followed it in training to the longest known context that ends there. A failure arc leads from a context to
the context without its first word. All arcs carry log10 weights:

    root:     P(w) = (1 - u) c(w) / N for words seen in training, u for all others together
              (u = share of training tokens that were seen once: Good and Turing)
    arc:      P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m)       h' is h without its first word
    failure:  weight m / (c(h) + m)

which sums to one over the words seen and the one class of others. m is the mean number of different words that follow a
context of that length in training (Witten and Bell), unless it is given. A text is read once from left to right: a word
without an arc is retried after each failure arc, whose weights add up, until an arc carries the state on.

Counts are spread over shards by the hash of the n-gram. The corpus is cut into parts of bounded size; a part asks each
shard for the counts of the distinct n-grams that it holds, and builds from the answers the part of the automaton that its
own texts can reach. So memory is bounded by the part and the shard, whatever the corpus. With more than `fan` shards
a request goes over relays, each of which merges what a group of parts asks of a group of shards, so that the number of
messages grows with the corpus and not with its square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, pieces, release, runs, strings
from .text import SPACE, join, mix, words

END = np.uint64(0x9D5C3A7B12E4F681)
START = np.uint64(0x3C6EF372FE94F82B)


def _planes(raw: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, each place compressed by itself: places that hardly vary take hardly any room."""
    parts = [pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) for x in raw.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T]
    return np.array([len(raw), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _from_planes(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data, "<u4", 9).tolist()
    out, at = np.empty((n, 8), np.uint8), 36
    for i, size in enumerate(sizes):
        out[:, i] = np.frombuffer(pa.decompress(data[at : at + size], n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending distinct 64-bit keys as the first one and gaps."""
    return _planes(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    large = np.flatnonzero(counts >= 255)
    raw = small.tobytes() + counts[large].astype(np.uint64).tobytes()
    return np.array([len(counts), len(large)], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(data: bytes) -> np.ndarray:
    n, large = np.frombuffer(data, "<u4", 2).tolist()
    raw = pa.decompress(data[8:], n + 8 * large, codec="zstd", asbytes=True)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n)
    return out


def key_bits(tokens: int) -> int:
    """Bits of an n-gram's hash that are kept: so many that it meets one of the corpus's other n-grams with a chance of
    2^-24 at most, as far as 63 bits go."""
    return min(63, 24 + max(1, tokens).bit_length())


# -- parts ----------------------------------------------------------------------------------------------------------

PART = "part long, doc_id array<long>, train array<boolean>, size array<int>, vocabulary binary, symbols binary"


def pack_symbols(symbols: np.ndarray) -> bytes:
    """32-bit numbers, most of them small, by planes of bytes."""
    planes = np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_symbols(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _parts(part_tokens: int, part_rows: int):
    """Rows (doc_id, train, text) -> parts. A part ends when it has that many tokens or rows, and has one text at least."""

    def run(batches):
        begin, made = TaskContext.get().partitionId() << 32, 0
        ids, train, hashes, sizes, rows, tokens = [], [], [], [], 0, 0

        def flush():
            nonlocal made, rows, tokens
            vocabulary, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
            cols = [
                pa.array([begin + made], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([pa.concat_arrays(train).to_pylist()], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([pack_symbols(symbols)], pa.binary()),
            ]
            made, rows, tokens = made + 1, 0, 0
            for x in (ids, train, hashes, sizes):
                x.clear()
            release()
            return pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "train", "size", "vocabulary", "symbols"])

        for batch in batches:
            data, offsets = strings(batch.column(2))
            for a, b in pieces(offsets, 1 << 20):
                w = words(data, offsets[a : b + 1], SPACE)
                n = np.diff(w.text) + 1
                h = np.insert(w.hash, w.text[1:], END)
                upto, c = np.cumsum(n), 0
                while c < b - a:
                    done = int(upto[c - 1]) if c else 0
                    d = max(c + 1, int(np.searchsorted(upto, done + part_tokens - tokens, "right")))
                    if rows and upto[c] - done > part_tokens - tokens:
                        yield flush()
                        continue
                    d = min(d, c + part_rows - rows, b - a)
                    ids.append(batch.column(0).slice(a + c, d - c))
                    train.append(batch.column(1).slice(a + c, d - c))
                    hashes.append(h[done : int(upto[d - 1])])
                    sizes.append(n[c:d].astype(np.int32))
                    rows, tokens, c = rows + d - c, tokens + int(upto[d - 1]) - done, d
                    if rows >= part_rows or tokens >= part_tokens:
                        yield flush()
        if rows:
            yield flush()

    return run


@dataclass
class Part:
    """The tokens of a part's texts, each text closed by the end token, and its n-grams of each order."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    ptr: np.ndarray
    grams: list[np.ndarray]  # grams[k]: key of the (k + 1)-gram that ends at each token; contexts reach back past START

    @classmethod
    def of(cls, vocabulary: bytes, symbols: bytes, size: np.ndarray, order: int, bits: int) -> "Part":
        ptr = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        known, at = unpack_sorted(vocabulary), unpack_symbols(symbols, int(ptr[-1]))
        tokens = known[at]
        grams = [mix(tokens)]
        start = START
        for _ in range(1, order):
            # contexts are padded with START to the left, so that every token has a context of every length
            before = np.empty(len(tokens), np.uint64)
            before[1:] = grams[-1][:-1]
            before[ptr[:-1]] = start
            grams.append(mix(join(before, tokens)))
            start = mix(join(np.array([start]), np.array([START])))[0]
        mask = np.uint64((1 << 64) - (1 << (64 - bits)))
        for g in grams:
            g &= mask
        return cls(known, at, ptr, grams)


# -- counts ---------------------------------------------------------------------------------------------------------

ASK = "node long, k int, slot long, keys binary, counts binary"
ANSWER = "node long, k int, slot long, seen binary, n long, kinds long, once long"


def _counted(gram: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how many training tokens each has. The lowest bit of a key is free for the mark of
    training, so that one sort in place does it."""
    both = gram | trained
    both.sort()
    first = np.ones(len(both), bool)
    first[1:] = (both[1:] ^ both[:-1]) > np.uint64(1)
    begin = np.flatnonzero(first)
    counts = np.add.reduceat((both & np.uint64(1)).astype(np.int32), begin) if len(begin) else np.zeros(0, np.int32)
    return both[begin] & ~np.uint64(1), counts


def _ends(slots: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Upper ends of the key ranges of slots low to high - 1 of so many."""
    return np.array([(i + 1) * (1 << 64) // slots - 1 for i in range(low, slots if high is None else high)], np.uint64)


def _split(node: int, k: int, keys: np.ndarray, counts: np.ndarray, ends: np.ndarray, low: int = 0) -> list[tuple]:
    cut = np.concatenate([[0], np.searchsorted(keys, ends, "right")]).tolist()
    return [(node, k, low + s, pack_sorted(keys[a:b]), pack_counts(counts[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "k", "slot", "keys", "counts"])


def _ask(order: int, slots: int, bits: int):
    """Parts -> what they ask of each slot, with their own counts in training."""
    ends = _ends(slots)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, _, train, size, vocabulary, symbols = (batch.column(i)[row] for i in range(6))
                p = Part.of(vocabulary.as_py(), symbols.as_py(), size.values.to_numpy(), order, bits)
                trained = np.repeat(train.values.to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(p.ptr))
                for k, gram in enumerate(p.grams):
                    keys, counts = _counted(gram, trained)
                    yield _batch(_split(part.as_py(), k, keys, counts, ends))
                del p, trained, keys, counts
                release()

    return run


def _merged(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The key lists asked for, all their keys in order, where each is among them, and their counts."""
    asked = [unpack_sorted(x) for x in t["keys"].to_pylist()]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([unpack_counts(x) for x in t["counts"].to_pylist()])
    return asked, keys, at, np.bincount(at, weights=counts.astype(float), minlength=len(keys)).astype(np.int64)


def _relay(shards: int, each: int):
    """Rows (up, k, slot, keys, counts) sorted by up and k: what a relay has been asked, merged and split by shard."""

    def run(batches):
        for t in runs(batches, ["up", "k"]):
            slot = t["slot"][0].as_py()
            _, keys, _, counts = _merged(t)
            ends = _ends(shards, slot * each, (slot + 1) * each)
            yield _batch(_split(t["up"][0].as_py(), t["k"][0].as_py(), keys, counts, ends, slot * each))
            release()

    return run


def _back(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """What the shards answered to a relay, for each of the parts that asked it."""
    lists, _, at, _ = _merged(asked)
    order = np.argsort(answers["slot"].to_numpy())
    seen = answers["seen"].to_pylist()
    total = np.concatenate([unpack_counts(seen[i]) for i in order.tolist()])[at]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return pa.table([asked["node"], asked["k"], asked["slot"], pa.array([pack_counts(total[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["node", "k", "slot", "seen"])


def _answer(batches):
    for t in runs(batches, ["k", "slot"]):
        asked, _, at, total = _merged(t)
        cut = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
        n = t.num_rows
        own = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())  # noqa: E731  once for each shard
        seen = [pack_counts(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        cols = [t["node"].combine_chunks(), t["k"].combine_chunks(), t["slot"].combine_chunks(), pa.array(seen, pa.binary()), own(total.sum()), own((total > 0).sum()), own((total == 1).sum())]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "k", "slot", "seen", "n", "kinds", "once"])
        release()


def _totals(parts: DataFrame, scratch: Scratch, order: int, bits: int, shards: int, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """The answers for each part (node, k, slot, seen), the sums over shards by k, and the number of slots."""
    tasks = lambda n: max(1, min(n, 20_000))  # noqa: E731  partitions; a task works on one run after another

    def answered(asked: DataFrame, n: int) -> DataFrame:
        return scratch.keep(asked.repartition(tasks(n), "k", "slot").sortWithinPartitions("k", "slot").mapInArrow(_answer, ANSWER), "answers")

    def sums(answers: DataFrame) -> DataFrame:
        return answers.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "kinds", "once")])

    if shards <= fan:
        answers = answered(parts.mapInArrow(_ask(order, shards, bits), ASK), shards)
        return answers.select("node", "k", "slot", "seen"), sums(answers), shards
    each = int(np.ceil(np.sqrt(shards)))  # shards of a slot
    slots = -(-shards // each)
    shards = slots * each
    groups = max(1, parts.count() // slots)  # a relay then holds about as many keys as a part
    up = F.pmod(F.xxhash64("node"), F.lit(groups)) * slots + F.col("slot")
    asked = scratch.keep(parts.mapInArrow(_ask(order, slots, bits), ASK).withColumn("up", up), "asked")
    merged = asked.repartition(tasks(groups * slots), "up", "k").sortWithinPartitions("up", "k").mapInArrow(_relay(shards, each), ASK)
    answers = answered(merged, shards)
    back = asked.groupBy("up", "k").cogroup(answers.select(F.col("node").alias("up"), "k", "slot", "seen").groupBy("up", "k"))
    return back.applyInArrow(_back, "node long, k int, slot long, seen binary"), sums(answers), slots


# -- the automaton --------------------------------------------------------------------------------------------------


@dataclass
class Corpus:
    """What the automaton needs to know of the whole corpus."""

    tokens: int
    kinds: int
    once: int
    texts: int
    pull: tuple[float, ...]

    def unseen(self) -> float:
        return 1.0 if not self.tokens else min(max(self.once, 0.5) / (self.tokens + 1), 0.999)


class Automaton:
    """States, arcs and failure arcs that the texts of a part can reach.

    State 0 is the root, states 1 to order - 1 are the start of a text seen as that many words, and each known context
    of the part follows. Arcs are found by state * width + symbol; the root has one for every symbol.
    """

    def __init__(self, p: Part, counts: list[np.ndarray], corpus: Corpus):
        """counts[k]: training count of the (k + 1)-gram that ends at each token of p."""
        order, n = len(counts), len(p.symbols)
        self.width = max(1, len(p.vocabulary))
        self.start = order - 1
        starts = np.arange(order)
        # state[k]: the context of k words that ends before each token, and whether training knows it
        state = [np.zeros(n, np.int64)]
        after = [np.zeros(n, np.int64)]  # the same for the context that ends with each token
        self.fail, self.fail_weight = [np.maximum(starts - 1, 0)], [np.zeros(order)]
        size = order
        for k in range(1, order):
            known = counts[k - 1] > 0
            keys, first, at = np.unique(p.grams[k - 1], return_index=True, return_inverse=True)
            number = np.cumsum(known[first]) - 1 + size
            own = np.where(known[first], number, -1)[at]
            shorter = after[k - 1]
            some = first[known[first]]
            m = corpus.pull[k - 1]
            self.fail.append(shorter[some])
            self.fail_weight.append(np.log10(m / (counts[k - 1][some] + m)))
            self.fail_weight[0][k] = np.log10(m / (corpus.texts + m))
            # a context that training does not know has no state of its own; the longest known one stands for it
            after.append(np.where(own >= 0, own, shorter))
            before = np.empty(n, np.int64)
            before[1:] = own[:-1]
            before[p.ptr[:-1]] = k if corpus.texts else -1
            state.append(before)
            size += len(some)
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(self.fail_weight)
        c = counts[0]
        u = corpus.unseen()
        prob = np.where(c > 0, (1 - u) * c / max(corpus.tokens, 1), u)
        self.root, self.root_to = np.zeros(self.width), np.zeros(self.width, np.int64)
        self.root[p.symbols] = np.log10(prob)
        self.root_to[p.symbols] = after[1] if order > 1 else 0
        keys, weights, targets = [], [], []
        for k in range(1, order):
            m = corpus.pull[k - 1]
            whole = np.where(state[k] < 0, 0, np.where(state[k] < order, corpus.texts, np.concatenate([[0], counts[k - 1][:-1]]) if n else 0))
            prob = (counts[k] + m * prob) / (whole + m)
            key, first = np.unique((state[k] * self.width + p.symbols)[(counts[k] > 0) & (state[k] >= 0)], return_index=True)
            at = np.flatnonzero((counts[k] > 0) & (state[k] >= 0))[first]
            keys.append(key)
            weights.append(np.log10(prob[at]))
            targets.append(after[min(k + 1, order - 1)][at])
        join_all = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        key = join_all(keys, np.int64)
        by = np.argsort(key, kind="stable")
        self.key, self.weight, self.target = key[by], join_all(weights, float)[by], join_all(targets, np.int64)[by]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word for each state: the log10 weight of the way and the state it leads to."""
        weight, target = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        state = state.copy()
        while len(todo):
            s, w = state[todo], symbol[todo]
            key = s * self.width + w
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            root = s == 0
            found = ~root & (self.key[at] == key) if len(self.key) else np.zeros(len(todo), bool)
            go, i = todo[found], at[found]
            weight[go] += self.weight[i]
            target[go] = self.target[i]
            go = todo[root]
            weight[go] += self.root[symbol[go]]
            target[go] = self.root_to[symbol[go]]
            todo = todo[~root & ~found]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return weight, target

    def traverse(self, p: Part, stretch: int = 512) -> np.ndarray:
        """log10 probability of each text, read from left to right with a carried state, all texts of the part in step.

        A long text is read in stretches at once. The state after order - 1 words depends on them alone, so a stretch
        that is not the first reads those before it from the root to find its state, and counts nothing there.
        """
        sizes = np.diff(p.ptr)
        n = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = p.ptr[:-1][text] + nth * stretch
        end = np.minimum(begin + stretch, p.ptr[1:][text])
        state = np.where(nth == 0, self.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in range(self.start, 0, -1):
            state[later] = self.step(state[later], p.symbols[begin[later] - back])[1]
        by = np.argsort(begin - end, kind="stable")  # longest first
        begin, size, state = begin[by], (end - begin)[by], state[by]
        total = np.zeros(len(text))
        live = len(text)
        for i in range(int(size[0]) if len(size) else 0):
            while size[live - 1] <= i:
                live -= 1
            weight, state[:live] = self.step(state[:live], p.symbols[begin[:live] + i])
            total[:live] += weight
        return np.bincount(text[by], weights=total, minlength=len(sizes))


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def language_scores(
    docs: DataFrame,
    scratch: Scratch,
    train,
    order: int = 3,
    pull: tuple[float, ...] | None = None,
    part_tokens: int = 1 << 19,
    part_rows: int = 4_096,
    shard_bytes: int = 8 << 20,
    fan: int = 4_096,
) -> DataFrame:
    """docs (doc_id, text) -> doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    `train` is a condition on doc_id; all rows that meet it are learnt from, all rows are scored. Tokens are words
    between ASCII white space, A-Z lower-cased, and one end token for each text; null texts are empty. base_score is
    the add-a-half unigram model's. Repeated rows count as often as they occur; rows without doc_id are rows like
    others; with nothing to learn from, every token is unseen. An empty table gives no rows; other columns are ignored.
    A part ends after part_tokens tokens or part_rows rows; a longer text is a part of its own, read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    # the written table fixes which rows are a part; a part is one row, so no reader divides it
    parts = scratch.keep(rows.mapInArrow(_parts(part_tokens, part_rows), PART), "parts")
    tokens, texts = parts.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("train", lambda x: x)))).first()
    shards = max(1, -(-(tokens or 0) * 8 // shard_bytes))
    bits = key_bits(tokens or 0)
    answers, sums, slots = _totals(parts, scratch, order, bits, shards, fan)
    found = {r["k"]: r for r in sums.collect()}  # one row for each order
    kinds = [found[k]["kinds"] if k in found else 0 for k in range(order)]
    if pull is None:  # the contexts of k words are those before the (k + 1)-grams: all k-grams but for the start of texts
        pull = tuple(max(kinds[k] / max(kinds[k - 1], 1), 0.1) for k in range(1, order))
    corpus = Corpus(found[0]["n"] if found else 0, kinds[0], found[0]["once"] if found else 0, texts or 0, pull)
    base_total = corpus.tokens + 0.5 * (corpus.kinds + 1)
    ends = _ends(slots)

    def run(left, right):
        """A part and the answers for it."""
        ids, trains, size = (left[c].combine_chunks().values for c in ("doc_id", "train", "size"))
        p = Part.of(left["vocabulary"][0].as_py(), left["symbols"][0].as_py(), size.to_numpy(), order, bits)
        got = {(k, s): i for i, (k, s) in enumerate(zip(right["k"].to_pylist(), right["slot"].to_pylist()))}
        seen, counts = right["seen"], []
        for k, gram in enumerate(p.grams):
            keys, at = np.unique(gram, return_inverse=True)
            cut = np.concatenate([[0], np.searchsorted(keys, ends, "right")])
            total = np.concatenate([unpack_counts(seen[got[k, s]].as_py()) for s in range(slots) if cut[s + 1] > cut[s]])
            counts.append(total[at])
        known = np.concatenate([[0], np.cumsum(counts[0] > 0)])
        base = np.add.reduceat(np.log10((counts[0] + 0.5) / base_total), p.ptr[:-1])
        a, b = p.ptr[:-1], p.ptr[1:]
        automaton = Automaton(p, counts, corpus)
        del counts, keys, at
        score = automaton.traverse(p)
        out = pa.table([ids, trains, pa.array(b - a, pa.int64()), pa.array(known[b] - known[a], pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])
        del automaton, p, score, base, known
        release()
        return out

    scored = parts.groupBy(F.col("part").alias("node")).cogroup(answers.groupBy("node")).applyInArrow(run, SCORES)
    return scored.withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))
