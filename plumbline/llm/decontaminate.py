"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Texts are streamed through the automaton, which keeps the length of the longest match that ends at each word. Words
are looked up with numpy; the automaton itself only walks stretches in which every pair of neighbouring words occurs
in an item, since elsewhere its match is shorter than the shortest window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, release, strings
from .text import SYMBOL, words


class Automaton:
    """Generalised suffix automaton; symbols are the places of word hashes in `vocabulary`."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        size = self.size = max(1, len(self.vocabulary))
        self.length, self.link, self.step, self.after = [0], [-1], {}, [[]]
        spelled = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items]
        for _, symbols in spelled:
            last = 0
            for c in symbols:
                last = self._extend(last, c)
        del self.after  # only building needs it
        self.shortest = min([window, *(len(s) for _, s in spelled if s)])
        pairs = [a * size + b for _, s in spelled for a, b in zip(s, s[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self._name(spelled)

    def _extend(self, last: int, c: int) -> int:
        step, length, link, size = self.step, self.length, self.link, self.size
        there = step.get(last * size + c)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, c, there)
        length.append(length[last] + 1)
        link.append(0)
        self.after.append([])
        new = len(length) - 1
        p = last
        while p != -1 and p * size + c not in step:
            step[p * size + c] = new
            self.after[p].append(c)
            p = link[p]
        if p != -1:
            q = step[p * size + c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        step, length, link, size = self.step, self.length, self.link, self.size
        length.append(length[p] + 1)
        link.append(link[q])
        twin = len(length) - 1
        self.after.append(list(self.after[q]))
        for s in self.after[q]:
            step[twin * size + s] = step[q * size + s]
        link[q] = twin
        while p != -1 and step.get(p * size + c) == q:
            step[p * size + c] = twin
            p = link[p]
        return twin

    def _name(self, spelled) -> None:
        """For each state whose class holds a string of `window` words, the items with it; for the state of a whole
        short item, its name and its length."""
        n, window = len(self.length), self.window
        self.short: dict[int, set[str]] = {}
        seen_by: dict[int, set[str]] = {}
        for name, symbols in spelled:
            v = 0
            for c in symbols:
                v = self.step[v * self.size + c]
                u = v
                while u > 0 and self.length[u] >= window and name not in seen_by.setdefault(u, set()):
                    seen_by[u].add(name)
                    u = self.link[u]
            if 0 < len(symbols) < window:
                self.short.setdefault(v, set()).add(name)
        self.of_window: dict[int, frozenset] = {}
        for v in range(1, n):
            u = v
            while self.length[u] >= window and self.length[self.link[u]] >= window:
                u = self.link[u]
            if self.length[u] >= window:
                self.of_window[v] = frozenset(seen_by[u])

    def walk(self, symbols: list[int]):
        """Yields (place of the last word, words that are hit, item names) for each place where a window ends."""
        step, link, length, size, window = self.step, self.link, self.length, self.size, self.window
        v = matched = 0
        for i, c in enumerate(symbols):
            to = step.get(v * size + c)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = step.get(v * size + c)
            if to is None:
                continue
            v, matched = to, matched + 1
            if matched >= window:
                yield i, matched, self.of_window[v]
            if self.short:
                u, most = v, matched
                while u > 0:
                    if u in self.short and length[u] <= most:
                        yield i, length[u], self.short[u]
                    u = link[u]

    def mark(self, hashes: np.ndarray, text: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> None:
        """Sets hit for words inside windows, and adds the items of each text."""
        if not len(self.vocabulary) or not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        linked = np.zeros(len(hashes), bool)  # to the word before
        if len(self.pairs):
            code = at[:-1] * self.size + at[1:]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            linked[1:] = (self.pairs[place] == code) & known[:-1] & known[1:]
        linked[text[:-1][text[:-1] < len(hashes)]] = False
        begin = np.flatnonzero(known & ~linked)
        follow = np.append(linked[1:], False)
        end = np.flatnonzero(known & ~follow) + 1
        long_enough = np.flatnonzero(end - begin >= self.shortest)
        owner = np.searchsorted(text, begin[long_enough], "right") - 1
        for k, t in zip(long_enough.tolist(), owner.tolist()):
            a, b = int(begin[k]), int(end[k])
            for i, n, names in self.walk(at[a:b].tolist()):
                hit[a + i - n + 1 : a + i + 1] = True
                items.setdefault(t, set()).update(names)


def automata(benchmark: DataFrame, window: int, block_words: int):
    """One automaton for every block of about block_words item words, built one after another on the driver."""
    held: list[tuple[str, np.ndarray]] = []
    n = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    for row in rows.toLocalIterator():
        data, ends = strings(pa.array([row["t"]]))
        h = words(data, ends, SYMBOL).hash
        if len(h):
            held.append((row["i"], h))
            n += len(h)
        if n >= block_words:
            yield Automaton(held, window)
            held, n = [], 0
    if held:
        yield Automaton(held, window)


def _scan(blocks: list):
    """Function of a string column -> (first row, last row, words, hit, items by text) for one piece of rows after
    another."""

    def scan(data, offsets):
        for a, b in pieces(offsets, 2 << 20 if len(blocks) < 2 else 16 << 20):
            w = words(data, offsets[a : b + 1], SYMBOL)
            hit, items = np.zeros(len(w.hash), bool), {}
            for block in blocks:
                block.value.mark(w.hash, w.text, hit, items)
                if len(blocks) > 1 and hasattr(block, "_value"):
                    del block._value  # one block in memory at a time; it stays on the executor's disk
            yield a, b, w, hit, items

    return scan


REPORT = "doc_id long, n_words long, n_hit long, items array<string>"


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, n_hit, items (sorted as strings).

    A window is `window` consecutive words of an item, or the whole of a shorter one. Null and empty texts have no
    words; items without words have no window; repeated rows change nothing, and items with equal ids count once; a
    null item_id is reported as the empty string. Empty tables are no special case. Whole texts are read, of any
    length. The automaton is broadcast; a benchmark of more than block_words words becomes several automata, of which
    an executor holds one at a time.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)]
    scan = _scan(blocks)

    def run(batches):
        for batch in batches:
            n_words, n_hit, names = [], [], []
            for a, b, w, hit, items in scan(*strings(batch.column(1))):
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(np.diff(w.text))
                n_hit.append(sums[w.text[1:]] - sums[w.text[:-1]])
                names += [sorted(items.get(t, ())) for t in range(b - a)]
            both = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_words, n_hit)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *both, pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """The documents without what they share with the benchmark; columns stay, n_chars follows the text.

    Each stretch of hit words is cut out of its text. A document of whose words more than most_coverage are hit goes
    as a whole. All others are kept; a text without hits, null and empty ones included, is not touched. Whole texts are
    read, of any length; repeated rows are treated alike, rows without doc_id like others, columns of any name stay, and
    empty tables are no special case.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)]
    scan = _scan(blocks)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            data, offsets = strings(batch.column(at))
            changed, keep = {}, np.ones(batch.num_rows, bool)
            for a, _, w, hit, _ in scan(data, offsets):
                for t in np.unique(np.searchsorted(w.text, np.flatnonzero(hit), "right") - 1).tolist():
                    lo, hi = int(w.text[t]), int(w.text[t + 1])
                    own = hit[lo:hi]
                    if own.mean() > most_coverage:
                        keep[a + t] = False
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    left, parts = int(offsets[a + t]), []
                    for s, e in edge.reshape(-1, 2).tolist():
                        parts.append(data[left : w.start[lo + s]].tobytes())
                        left = int(w.end[lo + e - 1])
                    parts.append(data[left : offsets[a + t + 1]].tobytes())
                    changed[a + t] = b"".join(parts).decode("utf-8", "replace")
            if changed:
                texts = batch.column(at).to_pylist()
                for i, x in changed.items():
                    texts[i] = x
                batch = batch.set_column(at, names[at], pa.array(texts, batch.schema.field(at).type))
                if counted is not None:
                    counts = batch.column(counted).to_pylist()
                    for i, x in changed.items():
                        counts[i] = len(x)
                    batch = batch.set_column(counted, names[counted], pa.array(counts, batch.schema.field(counted).type))
            yield batch if keep.all() else batch.filter(pa.array(keep))
            del batch, data, changed
            release()

    return docs.mapInArrow(run, schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
