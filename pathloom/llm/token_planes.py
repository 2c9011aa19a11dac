"""Operator 3: token ids in bit-plane shuffled, zstandard-compressed chunks.

Documents are range-partitioned and sorted by id; each partition is a shard.
A task encodes its texts one slice at a time and packs whole documents into
chunks.  A chunk's ids are cut into blocks of BLOCK_IDS; each block is
transposed into byte planes (or bit planes) and each plane is compressed on its
own.  The frame starts with a table of plane lengths, so any block can be read
without the others; the row around the frame says which documents it holds and
where they start.  The chunks and their index are Parquet rows in the shared
folder, written and read by Spark alone.

Frame, little-endian: ``PLN1``, planes' unit in bits (1 or 8) u8, 3 zero bytes,
ids u64, ids a block u32, blocks u32; for each block planes u32 and for each
plane its length u32; then the planes in that order.

With a byte-level tokenizer no token spans a single space or newline between
two other characters, or a letter and the stop that ends its word, so a text is
cut there and pieces are encoded once and remembered, found again by a hash and
compared byte by byte; a text with any other white space is encoded whole.  Both
ways give the ids of the whole text.

Defined cases: null text is encoded as empty, so it has the end id only; null
ids come first; equal ids are ordered by a hash of the text, repeated rows are
written each; a document of any length is one chunk at most; an empty table
gives no chunks; extra columns aren't written.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm import text_kernels as tk
from pathloom.llm.spark_tools import materialize

#: Ids of a block, and ids after which a chunk is closed.
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
LEVEL = 3
MAGIC = b"PLN1"
_HEAD = struct.Struct("<4sB3xQII")
#: Pieces remembered by a Python worker, and the ids they may have (some 80 MB).
PIECES = 1_500_000
PIECE_IDS = 8_000_000
#: Pieces that are encoded as one text.
TOGETHER = 100
#: Pieces of one character: codes 1, 2 and 3.
FIXED = ("\n", ".", ",")

CHUNKS = (
    "shard int, chunk int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, frame binary"
)

#: Bytes that may begin white space beyond ASCII, or white space but space and newline, or NUL.
_ODD = np.zeros(256, bool)
_ODD[[0, 9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def pack(ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS) -> bytes:
    """The frame of some ids (unsigned 32-bit)."""
    if bits not in (1, 8):
        raise ValueError("planes are of bits (1) or bytes (8)")
    press = zstandard.ZstdCompressor(level=LEVEL)
    table, planes, blocks = [], [], 0
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], "<u4")
        width = max(1, int(part.max()).bit_length())
        if bits == 8:
            rows = part.view(np.uint8).reshape(-1, 4).T[: -(-width // 8)]
        else:
            each = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            rows = np.packbits(each.T[:width], axis=1, bitorder="little")
        pressed = [press.compress(np.ascontiguousarray(r).tobytes()) for r in rows]
        table.append(struct.pack(f"<{1 + len(pressed)}I", len(pressed), *map(len, pressed)))
        planes += pressed
        blocks += 1
    return b"".join([_HEAD.pack(MAGIC, bits, len(ids), block, blocks), *table, *planes])


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame."""
    magic, bits, n_ids, block, blocks = _HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a plane frame")
    at, lengths = _HEAD.size, []
    for _ in range(blocks):
        (planes,) = struct.unpack_from("<I", frame, at)
        lengths.append(struct.unpack_from(f"<{planes}I", frame, at + 4))
        at += 4 + 4 * planes
    open_ = zstandard.ZstdDecompressor()
    out = np.zeros(n_ids, "<u4")
    for k, sizes in enumerate(lengths):
        n = min(block, n_ids - k * block)
        raw = []
        for size in sizes:
            raw.append(np.frombuffer(open_.decompress(frame[at : at + size]), np.uint8))
            at += size
        if bits == 8:
            part = np.zeros((n, 4), np.uint8)
            part[:, : len(raw)] = np.stack(raw, axis=1)
        else:
            each = np.zeros((32, n), np.uint8)
            each[: len(raw)] = np.unpackbits(np.stack(raw), axis=1, count=n, bitorder="little")
            part = np.packbits(each.T, axis=1, bitorder="little")
        out[k * block : k * block + n] = np.ascontiguousarray(part).view("<u4")[:, 0]
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs of so many from each start, one after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


class _Growing:
    """An array that is extended in place, with room to spare."""

    def __init__(self, values: np.ndarray):
        self.room, self.n = values.copy(), len(values)

    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty((self.n + len(values)) * 3 // 2, self.room.dtype)
            room[: self.n] = self.all()
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Numbered:
    """Numbers by 64-bit hash: a large sorted array and a small one of late comers."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.parts = [(keys[order], numbers[order].astype(np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for have, numbers in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                out = np.where(have[at] == keys, numbers[at], out)
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        large, late = self.parts
        keys, numbers = np.concatenate([late[0], keys]), np.concatenate([late[1], numbers])
        if len(keys) > 100_000:
            large, keys, numbers = (np.concatenate([large[0], keys]), np.concatenate([large[1], numbers])), keys[:0], numbers[:0]
            order = np.argsort(large[0], kind="stable")
            large = (large[0][order], large[1][order])
        order = np.argsort(keys)
        self.parts = [large, (keys[order], numbers[order])]


class PieceEncoder:
    """Encodes slices of texts; remembers the ids of pieces.

    New pieces are encoded many at a time as one text.  Pieces that begin with
    a space are strung together: each first token, and no other, begins with
    the letter that stands for a space.  Those without one are set on lines of
    their own: each newline is a token.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_piece = (
            not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(c.isspace() for x in added for c in x)
        )
        self.space, self.newline = self._marks()
        # Pieces by a 64-bit hash; before them the end of a document and FIXED.
        fixed = [np.array([end_id]), *(self._ids(x) for x in FIXED)]
        self.ids = _Growing(np.concatenate(fixed).astype(np.uint32))
        self.starts = _Growing(np.cumsum([0, *map(len, fixed)]))
        self.known = _Numbered(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # The pieces themselves, from code 1 + len(FIXED) on: 2 * bytes (+ 1 after a space), and their bytes in eights.
        self.marks = _Growing(np.zeros(0, np.int64))
        self.eights = _Growing(np.zeros(0, np.uint64))
        self.eights_at = _Growing(np.zeros(1, np.int64))
        self.uses = np.zeros(PIECES + 1 + len(FIXED), np.int32)

    def _marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a token begins with a space, whether it is a newline."""
        size = self.tokenizer.get_vocab_size()
        space, newline = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            space[i], newline[i] = token.startswith("\u0120"), token == "\u010a"
        return space, newline

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def _together(self, pieces: list[str], spaced: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each) for runs of pieces with (or without) a
        space before each."""
        runs = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        texts = [("" if spaced else "\n").join(r) for r in runs]
        out = []
        for run, text in zip(runs, texts, strict=True):
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            if spaced:
                sizes = np.diff(np.flatnonzero(self.space[got]), append=len(got))
            else:
                sizes = np.diff(np.flatnonzero(self.newline[got]), prepend=-1, append=len(got)) - 1
                got = got[~self.newline[got]]
            if len(sizes) != len(run):
                each = [self._ids(p) for p in run]
                got, sizes = np.concatenate(each), np.array([len(x) for x in each])
            out.append((got, sizes))
        return out

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Remember pieces; returns the order in which they are numbered."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, p in enumerate(pieces):
            kinds[2 if len(p) > 1000 else p[0] == " "].append(i)
        parts = [x for k in (1, 0) for x in self._together([pieces[i] for i in kinds[k]], k == 1)]
        for i in kinds[2]:
            ids = self._ids(pieces[i])
            parts.append((ids, np.array([len(ids)])))
        sizes = np.concatenate([n for _, n in parts])
        self.starts.extend(self.starts.all()[-1] + np.cumsum(sizes))
        self.ids.extend(np.concatenate([ids for ids, _ in parts]).astype(np.uint32))
        return np.array(kinds[1] + kinds[0] + kinds[2])

    def forget(self) -> None:
        """Keep the most used half of the pieces."""
        names, codes = self.known.all()
        order = np.argsort(-self.uses[codes], kind="stable")[: PIECES // 2]
        starts = self.starts.all()
        sizes = np.diff(starts)
        room = np.cumsum(sizes[codes[order]]) <= PIECE_IDS // 2
        kept = order[room & (self.uses[codes[order]] > 1)]
        chosen = np.concatenate([np.arange(1 + len(FIXED)), codes[kept]])
        self.ids = _Growing(self.ids.all()[_runs(starts[chosen], sizes[chosen])])
        self.starts = _Growing(np.concatenate([[0], np.cumsum(sizes[chosen])]))
        self.known = _Numbered(names[kept], 1 + len(FIXED) + np.arange(len(kept)))
        own, bounds = codes[kept] - 1 - len(FIXED), self.eights_at.all()
        blocks = self.eights.all()[_runs(bounds[own], np.diff(bounds)[own])]
        self.eights, self.eights_at = _Growing(blocks), _Growing(np.concatenate([[0], np.cumsum(np.diff(bounds)[own])]))
        self.marks = _Growing(self.marks.all()[own])
        self.uses[:] = 0

    def _codes_of(self, names: np.ndarray, piece, words: tk.Words, which: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The codes of distinct hashes; ``piece(i)`` is the text of the i-th,
        word which[i] of the slice."""
        codes = self.known.find(names)
        new = np.flatnonzero(codes < 0)
        if len(new):
            first = len(self.starts.all()) - 1
            order = new[self.learn([piece(i) for i in new])]
            codes[order] = first + np.arange(len(new))
            self.known.add(names[new], codes[new])
            sizes, begin = words.n_blocks[which[order]], (np.cumsum(words.n_blocks) - words.n_blocks)[which[order]]
            self.eights.extend(words.blocks[_runs(begin, sizes)])
            self.eights_at.extend(self.eights_at.all()[-1] + np.cumsum(sizes))
            self.marks.extend(marks[order])
        return codes

    def _others(self, codes: np.ndarray, marks: np.ndarray, w: tk.Words, cut: np.ndarray) -> np.ndarray:
        """Which of the chosen words aren't the pieces that have their codes."""
        own = codes - 1 - len(FIXED)
        other = self.marks.all()[own] != marks
        sizes = np.where(other, 0, w.n_blocks[cut])
        owner = np.repeat(np.arange(len(own)), sizes)
        mine = w.blocks[_runs((np.cumsum(w.n_blocks) - w.n_blocks)[cut], sizes)]
        other[owner[mine != self.eights.all()[_runs(self.eights_at.all()[own], sizes)]]] = True
        return other

    def encode(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end ids, number of ids of each text)."""
        # The next texts have fewer new pieces than bytes.
        if len(self.starts.all()) + len(w.starts) > PIECES or len(self.ids.all()) > PIECE_IDS:
            self.forget()
        filled = np.diff(w.offsets) > 0
        return self._encode(w, filled & _cut_badly(w.offsets, w.data) if self.by_piece else filled)

    def _encode(self, w: tk.Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode; texts in ``whole`` aren't cut."""
        raw, n = w.data.tobytes(), len(w)
        doc = np.repeat(np.arange(n), np.diff(w.bounds))
        cut = ~whole[doc]
        starts, ends, doc = w.starts[cut], w.ends[cut], doc[cut]
        before = np.where(starts > w.offsets[doc], w.data[np.maximum(starts - 1, 0)] if len(w.data) else 0, 0)
        spaced, newline = before == 32, before == 10
        names, first, which = np.unique(
            w.hashes[cut] ^ np.where(spaced, _SPACED, np.uint64(0)), return_index=True, return_inverse=True
        )
        begin = (starts - spaced)[first]
        marks = 2 * (ends - starts) + spaced
        codes = self._codes_of(names, lambda i: raw[begin[i] : ends[first[i]]].decode(), w, np.flatnonzero(cut)[first], marks[first])
        other = self._others(codes[which], marks, w, cut)
        if other.any():  # another piece has this hash
            return self._encode(w, whole | (np.bincount(doc[other], minlength=n) > 0))
        after = np.where(ends < w.offsets[doc + 1], w.data[np.minimum(ends, len(w.data) - 1)] if len(w.data) else 0, 0)
        stop = np.where(after == 46, 2, np.where(after == 44, 3, 0))
        # A text's pieces: its words, with a newline before or a stop after some; or itself.
        pieces = 1 + newline + (stop > 0)
        sizes = np.bincount(doc, pieces, n).astype(np.int64)
        sizes[whole] = 1
        last = np.cumsum(sizes + 1)
        stream = np.zeros(int(last[-1]) if n else 0, np.int64)
        before_it = np.concatenate([[0], np.cumsum(pieces)])
        opens = np.searchsorted(doc, np.arange(n))
        at = (last - sizes - 1 - before_it[opens])[doc] + before_it[:-1] + newline
        stream[at] = codes[which]
        stream[at[newline] - 1] = 1
        stream[at[stop > 0] + 1] = stop[stop > 0]
        used = np.bincount(stream, minlength=2)[: len(self.uses)]
        self.uses[: len(used)] += used.astype(np.int32)
        got, starts = self.ids.all(), self.starts.all()
        alone = {int(i): self._ids(raw[w.offsets[i] : w.offsets[i + 1]].decode()) for i in np.flatnonzero(whole)}
        if alone:  # their ids follow the remembered ones for now
            stream[[last[i] - 2 for i in alone]] = len(starts) - 1 + np.arange(len(alone))
            starts = np.concatenate([starts, starts[-1] + np.cumsum([len(x) for x in alone.values()])])
            got = np.concatenate([got, *(x.astype(np.uint32) for x in alone.values())])
        origin = starts[stream]
        sizes = starts[stream + 1] - origin
        ends = np.cumsum(sizes)
        return got[_runs(origin, sizes)], np.diff(ends[last - 1], prepend=0)


#: Set apart the hash of a word with a space before it.
_SPACED = np.uint64(0x2545F4914F6CDD1D)


def _cut_badly(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Texts in which a space or newline isn't between two other characters, or
    that may hold other white space."""
    blank = (data == 32) | (data == 10)
    bad = _ODD[data]
    bad[1:] |= blank[1:] & blank[:-1]
    filled = offsets[1:] > offsets[:-1]
    for at in (offsets[:-1][filled], offsets[1:][filled] - 1):
        bad[at] |= blank[at]
    where = np.searchsorted(np.flatnonzero(bad), offsets)
    return where[1:] > where[:-1]


_encoders: dict[tuple, PieceEncoder] = {}


def write_chunks(
    docs: DataFrame, tokenizer_json: str, end_id: int, key: str = "doc_id", text: str = "text", bits: int = 8
) -> DataFrame:
    """The CHUNKS table of all texts in ascending order of ``key``, written to
    the shared folder and read back."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a tokenizer file: a few MB
    name = (zlib.crc32(tokenizer_json.encode()), end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:  # once for each Python worker
            _encoders.clear()
            _encoders[name] = PieceEncoder(vocabulary.value, end_id)
        encoder, shard = _encoders[name], TaskContext.get().partitionId()
        chunk = done = held = 0
        keys, sizes, ids = [], [], []

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            row = [[shard], [chunk], [done], [len(all_ids)], [keys], [sizes], [pack(all_ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)],
                names=["shard", "chunk", "shard_start", "n_ids", "doc_ids", "n_tokens", "frame"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for w in tk.words(batch.column(1), stops=True):
                got, counts = encoder.encode(w)
                keys += names[w.first_row : w.first_row + len(w)]
                sizes += counts.tolist()
                ids.append(got)
                held += len(got)
                if held >= CHUNK_IDS:
                    yield close()
                    chunk, done, held, keys, sizes, ids = chunk + 1, done + held, 0, [], [], []
        if keys:
            yield close()

    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return materialize(dealt.mapInArrow(run, CHUNKS), "token-chunks")


def write_index(chunks: DataFrame) -> DataFrame:
    """The index of a written CHUNKS table, written beside it and read back:
    shard, chunk, start (ids before it), n_ids, n_docs, frame_bytes, first_doc,
    last_doc.  A row a chunk; the window is over a row a shard."""
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids_of_shard"))
    before = F.sum("ids_of_shard").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_base"))
    rows = chunks.join(F.broadcast(bases), "shard").select(
        "shard",
        "chunk",
        (F.col("shard_base") + F.col("shard_start")).alias("start"),
        "n_ids",
        F.size("doc_ids").cast("long").alias("n_docs"),
        F.octet_length("frame").alias("frame_bytes"),
        F.get("doc_ids", F.lit(0)).alias("first_doc"),
        F.element_at("doc_ids", -1).alias("last_doc"),
    )
    return materialize(rows, "token-index")


def read_documents(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the frames and
    the shards' starts in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, frame, start = (batch.column(i)[row].as_py() for i in range(4))
                ids = unpack(frame).tobytes()
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - np.array(sizes, np.int64)
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + start, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    bases = F.broadcast(index.groupBy("shard").agg(F.min("start").alias("base")))  # a row a shard: a partition of the writer
    rows = chunks.join(bases, "shard").select("doc_ids", "n_tokens", "frame", (F.col("base") + F.col("shard_start")).alias("start"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_planes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode every document, write the chunks and read the documents back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chunks = write_chunks(docs, spec, end_id)
    return read_documents(chunks, write_index(chunks))
