"""Token ids in fixed-width bit-packed files.

A file holds the ids of a range of documents in ascending doc_id order:

    magic (8 bytes), length of the header (u32), header (JSON: bits, block, n_ids, n_docs, n_blocks),
    byte offset of each block from the start of the payload (u64 each), doc ids (i64 each), null flags of doc ids
    (u8 each), number of ids up to the end of each document (u64 each), payload.

Every id takes the fewest bits that hold the vocabulary, low bits first. A block holds `block` ids and begins at a byte
boundary, so any range of ids is read by seeking to its blocks and unpacking them with numpy.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, pieces, release, strings

MAGIC = b"PLUMBIT1"
BLOCK = 4096
#: ASCII signs but the apostrophe, which may belong to a contraction.
SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def width(vocabulary: int) -> int:
    """Bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = raw
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class TokenWriter:
    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.rest = np.zeros(0, np.uint32)
        self.payload: list[bytes] = []
        self.doc_ids: list[pa.Array] = []
        self.ends: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.ends.append(self.n_ids + np.cumsum(lengths))
        self.n_ids += len(ids)
        both = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(both) // self.block * self.block
        for i in range(0, whole, self.block):
            self.payload.append(pack(both[i : i + self.block], self.bits))
        self.rest = both[whole:]

    def write(self, stream) -> None:
        if len(self.rest):
            self.payload.append(pack(self.rest, self.bits))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in self.payload])])[:-1] if self.payload else np.zeros(0)
        doc_ids = pa.chunked_array(self.doc_ids, pa.int64()).combine_chunks()
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0)
        head = json.dumps({"bits": self.bits, "block": self.block, "n_ids": self.n_ids, "n_docs": len(doc_ids), "n_blocks": len(offsets)}).encode()
        stream.write(MAGIC + struct.pack("<I", len(head)) + head)
        stream.write(offsets.astype("<u8").tobytes())
        stream.write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        stream.write(doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
        stream.write(ends.astype("<u8").tobytes())
        for p in self.payload:
            stream.write(p)


class TokenFile:
    """Random access to a file that TokenWriter wrote; `source` has seek() and read()."""

    def __init__(self, source):
        self.source = source
        if source.read(8) != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", source.read(4))
        head = json.loads(source.read(size))
        self.bits, self.block, self.n_ids, n, blocks = (head[k] for k in ("bits", "block", "n_ids", "n_docs", "n_blocks"))
        self.offsets = np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(source.read(8 * n), "<i8")
        self.null = np.frombuffer(source.read(n), "u1").astype(bool)
        self.ends = np.frombuffer(source.read(8 * n), "<u8").astype(np.int64)
        self.base = 12 + size + 8 * blocks + 17 * n

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1, whichever documents they belong to."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        self.source.seek(self.base + int(self.offsets[a]))
        n = min(self.n_ids, (b + 1) * self.block) - a * self.block
        whole = n // self.block * self.block
        data = self.source.read((whole * self.bits + 7) // 8 + ((n - whole) * self.bits + 7) // 8)
        return unpack(data, self.bits, n)[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


#: The normalizer and the way to part a text for which Encoder may work chunk by chunk.
CHUNKED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def load(path: str):
    """The tokenizer, and whether its texts may be encoded chunk by chunk: it must drop white space, lower-case, part
    signs from letters and have no marks but its special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    parts = json.loads(found.to_str())
    plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in parts["added_tokens"])
    return found, plain and (parts["normalizer"], parts["pre_tokenizer"]) == CHUNKED and not parts["truncation"] and not parts["padding"]


def vocabulary_size(path: str, end_id: int) -> int:
    """One more than the largest id."""
    return max(end_id, *load(path)[0].get_vocab(with_added_tokens=True).values()) + 1


class PlainEncoder:
    """Any tokenizer, text by text. It remembers nothing."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and their numbers by text."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        got = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for ids in got for x in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks between ASCII white space, none across texts, and how many stand before each text and in all."""
    black = ~SPACE[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner], last[inner - 1] = black[inner], black[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[black])])
    return chunks, np.searchsorted(starts, offsets)


class Encoder:
    """The tokenizer with a memory of what chunks between ASCII white space become.

    A tokenizer of this kind (CHUNKED) drops white space and never joins across it, so a text's ids are those of its
    chunks in order. When the memory holds more than `most` chunks, or 64 times as many bytes of them, the rarer ones
    are forgotten.
    """

    def __init__(self, tokenizer, end_id: int, most: int):
        self.tokenizer = tokenizer
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id, self.most = end_id, most
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.large_binary())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.bytes = 0
        self.start, self.size, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps what has been met most often, half the memory at most."""
        least = 2
        while (self.hits >= least).sum() > self.most // 2:
            least *= 2
        keep = np.flatnonzero(self.hits >= least)
        names = self.names.take(pa.array(keep))
        if (pc.sum(pc.binary_length(names)).as_py() or 0) > 32 * self.most:
            return self.clear()
        (ids, _), sizes, hits = self._gather(keep), self.size[keep], self.hits[keep] // 2
        self.clear()
        self._store(names, ids, sizes)
        self.hits[:] = hits

    def _store(self, chunks: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Their places."""
        need = len(ids)
        if self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + need] = ids
        first = len(self.size)
        self.names = pa.concat_arrays([self.names, chunks])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(sizes), np.int64)])
        self.used += need
        self.bytes += pc.sum(pc.binary_length(chunks)).as_py() or 0
        return range(first, first + len(chunks))

    def _find(self, chunks: pa.Array) -> np.ndarray:
        """Places of chunks, -1 where there is none."""
        return pc.index_in(chunks, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stored chunks one after another, and the offsets of each."""
        n = self.size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])], total

    def _learn(self, chunks: list[bytes], special: bool) -> np.ndarray:
        """Stores chunks that have no place, and gives their places. Small ASCII letters alone are one unit of the model and
        go to it straight. A chunk whose last letter or digit is ASCII and followed by ASCII signs only is its two sides,
        since the tokenizer always parts them there. All else goes through the whole tokenizer, many chunks in one call.
        Chunks with the name of a special token go there one by one."""
        place: dict[bytes, int] = {}

        def store(some: list[bytes], ids, sizes) -> None:
            place.update(zip(some, self._store(pa.array(some, pa.large_binary()), np.array(ids, np.uint32), np.array(sizes, np.int64))))

        named = {c for c in chunks if any(name in c for name in self.special)} if special else set()
        if named:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in named], add_special_tokens=False)]
            store(list(named), list(chain.from_iterable(got)), list(map(len, got)))
        parted, simple = [], set()
        for c in chunks:
            if c in named:
                continue
            core = c.rstrip(SIGNS)
            if core and len(core) < len(c) and core[-1] in LETTERS:
                tail = c[len(core) :]
                parted.append((c, core, tail))
                simple.add(core)
                simple.add(tail)
            else:
                simple.add(c)
        simple = list(simple)
        known = self._find(pa.array(simple, pa.large_binary()))
        place.update((c, at) for c, at in zip(simple, known.tolist()) if at >= 0)
        new = [simple[i] for i in np.flatnonzero(known < 0).tolist()]
        letters, others = [], []
        for c in new:
            (letters if c.isalpha() and c.islower() else others).append(c)
        if letters:
            tokenize = self.tokenizer.model.tokenize
            got = [[t.id for t in tokenize(c.decode())] for c in letters]
            store(letters, list(chain.from_iterable(got)), list(map(len, got)))
        for i in range(0, len(others), 20_000):
            some = others[i : i + 20_000]
            e = self.tokenizer.encode([c.decode("utf-8", "replace") for c in some], is_pretokenized=True, add_special_tokens=False)
            store(some, e.ids, np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        if parted:
            at = np.array([place[x] for _, core, tail in parted for x in (core, tail)])
            ids, _ = self._gather(at)
            store([c for c, _, _ in parted], ids, self.size[at].reshape(-1, 2).sum(1))
        return np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and their numbers by text."""
        if len(self.names) > self.most or self.bytes > 64 * self.most:
            self.forget()
        raw = data[int(offsets[0]) : int(offsets[-1])].tobytes()
        special = any(name in raw for name in self.special)
        if not special:  # the tokenizer lower-cases all but these
            raw = raw.lower()
        chunks, upto = split(np.frombuffer(raw, np.uint8), offsets - offsets[0])
        chunks = chunks.dictionary_encode()
        at = self._find(chunks.dictionary)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(chunks.dictionary.take(pa.array(new)).to_pylist(), special)
        at = at[chunks.indices.to_numpy()]
        self.hits += np.bincount(at, minlength=len(self.hits))
        ids, total = self._gather(at)
        ends = total[upto[1:]]
        return np.insert(ids, ends, self.end_id), np.diff(np.concatenate([[0], ends])) + 1


_encoders: dict = {}


def encoder(path: str, end_id: int, remember: int) -> Encoder | PlainEncoder:
    if (path, end_id) not in _encoders:
        tokenizer, chunked = load(path)
        _encoders[path, end_id] = Encoder(tokenizer, end_id, remember) if chunked else PlainEncoder(tokenizer, end_id)
    if isinstance(_encoders[path, end_id], Encoder):
        _encoders[path, end_id].most = remember
    return _encoders[path, end_id]


MANIFEST = "shard long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, scratch: Scratch, vocabulary_path: str, end_id: int = 2, shard_bytes: int = 12 << 20, remember: int = 400_000) -> DataFrame:
    """Encodes docs (doc_id, text) into files below the scratch folder and returns their manifest, a written table.

    Documents go to files by range of doc_id (nulls first; equal ids by text), so files in order of `shard` hold all
    documents in order. A file's name is unique to the attempt that wrote it and only files of attempts that ended are
    in the manifest, so lost executors leave no wrong file in use. Null and empty texts are the end id alone; repeated
    rows are written each; rows without doc_id come first. An empty table has no files. Other columns are ignored. Texts
    are read whole; a shard is about shard_bytes of text, and one text at least. Ids take the bits of the tokenizer's
    own largest id. A worker remembers the ids of `remember` chunks at most, which trades its memory for time and changes
    no result.
    """
    from pyarrow import fs

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    root, bits = scratch.path("tokens"), width(vocabulary_size(vocabulary_path, end_id))
    where, inside = fs.FileSystem.from_uri(root)
    where.create_dir(inside, recursive=True)

    def run(batches):
        enc, out = encoder(vocabulary_path, end_id, remember), TokenWriter(bits)
        n_docs = 0
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in pieces(offsets, 2 << 20):
                ids, lengths = enc.encode(data, offsets[a : b + 1])
                out.add(batch.column(0).slice(a, b - a), ids, lengths)
            n_docs += batch.num_rows
        if n_docs:
            task = TaskContext.get()
            path = f"{root}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.bits"
            store, name = fs.FileSystem.from_uri(path)
            with store.open_output_stream(name) as stream:
                out.write(stream)
            n_ids = out.n_ids
            del out
            release()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.withColumn("__tie", order[1]).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "__tie")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__tie").drop("__tie")
    return scratch.keep(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the
    ids as little-endian 32-bit numbers)."""
    from pyarrow import fs

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    f = TokenFile(source)
                    first = 0
                    while first < len(f.ends):
                        begin = int(f.ends[first - 1]) if first else 0
                        last = max(first + 1, int(np.searchsorted(f.ends, begin + (1 << 20), "right")))
                        raw = f.ids(begin, int(f.ends[last - 1])).astype("<u4").tobytes()
                        ends = f.ends[first:last]
                        starts = np.concatenate([[begin], ends[:-1]])
                        crc = [zlib.crc32(raw[4 * (s - begin) : 4 * (e - begin)]) for s, e in zip(starts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f.doc_ids[first:last], pa.int64(), mask=f.null[first:last]), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first = last

    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
