"""Operator 1: benchmark decontamination with one Aho-Corasick automaton.

Item texts are normalised to lower-case words; each run of WINDOW words (an item
of fewer words: all of it) is a pattern.  A word of the items is one symbol of
the automaton, so it has a node for a word of a window rather than for a letter.
Texts are split the same way, many at once, into symbols with their offsets in
the original; words that no item has are one more symbol.  Each text is scanned
once, and where patterns end in the scan tells the words they cover and, by the
offsets, their characters.  Words are recognised by a 64-bit hash.

Patterns are broadcast in blocks of about MAX_BLOCK_BYTES of item text (some
150 bytes of automaton each); more items take more blocks, each with its own
scan, and the hits of a document are added up.

Defined cases: null or empty text has no words and isn't contaminated; null
item text has no windows; a null item_id is written "null"; items that share
an id count once; repeated documents get a row each; an empty benchmark hits
nothing; of windows that overlap or contain each other each counts; texts of any
length are read whole; extra columns are ignored by ``find`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import text_kernels as tk

#: Words of a window.
WINDOW = 13
#: Bytes of item text in one automaton.
MAX_BLOCK_BYTES = 2 << 20

SPANS = "array<struct<item_id:string,first_word:bigint,last_word:bigint,start_char:bigint,end_char:bigint>>"
FOUND = f"n_words bigint, hit_words array<bigint>, item_ids array<string>, spans {SPANS}"


class Machine:
    """The automaton of all windows of some items, over word symbols.  Symbol 0
    stands for words of no item and for the end of a text."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        texts = pa.array([text for _, text in items], pa.string())
        slices = list(tk.words(texts, lower=True, between=tk.MARKS))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in slices)]))
        owners: dict[str, set[str]] = {}
        for w in slices:
            line = self._symbols(w.hashes)
            for i in range(len(w)):
                own = line[w.bounds[i] : w.bounds[i + 1]]
                for k in range(max(1, len(own) - size + 1) if own else 0):
                    owners.setdefault(own[k : k + size], set()).add(items[w.first_row + i][0])
        self.automaton = ahocorasick.Automaton() if owners else None
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()

    def _symbols(self, hashes: np.ndarray) -> str:
        """A character a word; surrogates are left out of the numbering."""
        at = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        points = np.where(at + 1 < 0xD800, at + 1, at + 1 + 0x800)
        return np.where(known, points, 0).astype("<u4").tobytes().decode("utf-32-le")

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, tuple[str, ...]]], tuple]]:
        """For each text: its number of words, [(first word, last word, item
        ids)], and what ``characters`` takes to place words in the original."""
        for w in tk.words(texts, lower=True, between=tk.MARKS):
            counts = np.diff(w.bounds)
            hits: list[list] = [[] for _ in range(len(w))]
            if self.automaton is not None:
                # One text after the other, with a 0 between.
                doc = np.repeat(np.arange(len(w)), counts)
                ends = np.cumsum(counts + 1)
                line = np.zeros(int(ends[-1]) if len(w) else 0, np.uint64)
                line[np.arange(len(doc)) + doc] = w.hashes
                joined = np.frombuffer(self._symbols(line).encode("utf-32-le"), "<u4").copy()
                joined[ends - 1] = 0
                found = list(self.automaton.iter(joined.tobytes().decode("utf-32-le")))
                owner = np.searchsorted(ends, [end for end, _ in found], "right")
                for (end, (n, ids)), i in zip(found, owner, strict=True):
                    last = end - int(ends[i] - counts[i] - 1)
                    hits[i].append((last - n + 1, last, ids))
            for i in range(len(w)):
                yield int(counts[i]), hits[i], (w, i)


def characters(w: tk.Words, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of text i of a slice, in characters."""
    low, high = w.offsets[i], w.offsets[i + 1]
    letters = np.concatenate([[0], np.cumsum((w.data[low:high] & 0xC0) != 0x80)])
    own = slice(w.bounds[i], w.bounds[i + 1])
    return letters[w.starts[own] - low], letters[w.ends[own] - low]


_machines: dict[str, object] = {}
_PLACE = pa.struct(
    [("item_id", pa.string())] + [(x, pa.int64()) for x in ("first_word", "last_word", "start_char", "end_char")]
)
_FIELDS = {
    "n_words": pa.int64(),
    "hit_words": pa.list_(pa.int64()),
    "item_ids": pa.list_(pa.string()),
    "spans": pa.list_(_PLACE),
}


def _report(n: int, hits: list, place: tuple, spans: bool) -> tuple[int, list[int], list[str], list[dict]]:
    """The FOUND fields of one text."""
    if not hits:
        return n, [], [], []
    words = sorted({k for a, b, _ in hits for k in range(a, b + 1)})
    places = []
    if spans:
        starts, ends = characters(*place)
        places = [
            {"item_id": i, "first_word": a, "last_word": b, "start_char": int(starts[a]), "end_char": int(ends[b])}
            for a, b, owners in hits
            for i in owners
        ]
    return n, words, sorted({i for *_, owners in hits for i in owners}), places


def _scanner(patterns, key: str, column: str, spans: bool, follows: bool):
    """A mapInArrow function that appends the FOUND fields to each row or, where
    it follows another block of items, adds to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _machines:  # once for each Python worker
            _machines.clear()
            _machines[key] = Machine(*patterns.value)
        machine = _machines[key]
        for batch in batches:
            rows = [_report(*found, spans) for found in machine.scan(batch.column(batch.schema.get_field_index(column)))]
            kept, names = batch.columns, batch.schema.names
            if follows:
                old = zip(*(c.to_pylist() for c in kept[-4:]), strict=True)
                rows = [
                    (n, sorted({*w, *w2}), sorted({*i, *i2}), s + s2)
                    for (n, w, i, s), (_, w2, i2, s2) in zip(rows, old, strict=True)
                ]
                kept, names = kept[:-4], names[:-4]
            fields = zip(*rows, strict=True) if rows else ([] for _ in _FIELDS)
            new = [pa.array(list(x), kind) for x, kind in zip(fields, _FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, *_FIELDS])

    return run


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, by hash of id and text."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // MAX_BLOCK_BYTES
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    spans: bool = True,
) -> DataFrame:
    """``docs`` with n_words, hit_words (word numbers), item_ids and spans with
    offsets into the original text, in characters.  Columns of these names are
    replaced."""
    found = docs.drop(*[c for c in docs.columns if c.lower() in _FIELDS])
    fields = T.StructType(found.schema.fields + T._parse_datatype_string(FOUND).fields)
    for k, block in enumerate(_item_blocks(items, item_id, item_text)):
        patterns = docs.sparkSession.sparkContext.broadcast((block, size))
        found = found.mapInArrow(_scanner(patterns, uuid.uuid4().hex, text, spans, k > 0), fields)
    return found


def contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    hit = F.size("hit_words").cast("long")
    return (hit > 0) & (hit * 20 >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    own = {c: f"own_{c}" for c in docs.columns if c.lower() in _FIELDS}
    clean = find(docs.withColumnsRenamed(own), items, text, spans=False).where(~contaminated())
    return clean.drop(*_FIELDS).withColumnsRenamed({v: k for k, v in own.items()})


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items, and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, items, spans=False).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH item_words AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, row_number() OVER () AS item_row,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size,
           array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
    FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc_words AS (
    SELECT doc_id, row_number() OVER () AS doc_row,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
grams AS (
    SELECT doc_row, i, s.size, array_to_string(list_slice(w, i, i + s.size - 1), ' ') AS gram
    FROM doc_words, (SELECT DISTINCT size FROM item_windows) s, unnest(range(1, len(w) - s.size + 2)) AS t(i)),
hits AS (
    SELECT g.doc_row, g.i, g.size, v.item_id FROM grams g JOIN item_windows v ON g.gram = v.gram AND g.size = v.size),
hit_words AS (
    SELECT doc_row, count(DISTINCT k) AS n_hit
    FROM (SELECT DISTINCT doc_row, i, size FROM hits), unnest(range(i, i + size)) AS t(k) GROUP BY doc_row),
hit_items AS (
    SELECT doc_row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_row, item_id FROM hits) GROUP BY doc_row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_row) LEFT JOIN hit_items USING (doc_row)
"""
