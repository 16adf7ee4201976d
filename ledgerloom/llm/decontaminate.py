"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

The automaton's alphabet is the normalised word. A window is ten consecutive words of an item.
Of each item the automaton holds pieces of five words, one at every sixth word: any window
contains one whole. A text is scanned once; each piece that occurs is compared with the item
to both sides, and where ten words or more agree, the windows in them occur. Matches give word
positions, from which offsets in the original text follow. Items shorter than a window are
in the automaton whole. A word that no item has leads back to the root, so only stretches of
known words that are long enough for the shortest entry are fed to the automaton.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Item bytes in one automaton (it takes about ten times as much memory). All usual benchmarks
#: together fit; more items are scanned in several automata, one at a time, each built anew for
#: every GROUP_BYTES of text.
AUTOMATON_BYTES, GROUP_BYTES = 16 << 20, 64 << 20

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])

OUTSIDE, BETWEEN = -2, -1  # before and after a text's words, and an item's


class Items:
    """The automaton of some items, and what is needed to check its matches."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.numbers = window, {}
        self.piece = (window + 1) // 2
        step, numbers = window - self.piece + 1, self.numbers
        owners: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            seq = tuple(numbers.setdefault(w, len(numbers) + 1) for w in text.translate(C.NORMAL_BYTES).split())
            if seq:
                owners.setdefault(seq, set()).add(item_id)
        self.ids = list(owners.values())
        flat, entries = [BETWEEN] * window, {}
        for k, seq in enumerate(owners):
            if len(seq) < window:
                entries.setdefault(seq, ([], []))[1].append(k)
            else:
                for at in range(0, len(seq) - self.piece + 1, step):
                    entries.setdefault(seq[at : at + self.piece], ([], []))[0].append((len(flat) + at, k))
                flat += seq
                flat += [BETWEEN] * window
        self.flat = np.array(flat, np.int32)
        self.least = min(map(len, entries), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        while entries:
            seq, (places, whole) = entries.popitem()
            self.automaton.add_word(seq, (len(seq), np.array(places, np.int64).reshape(-1, 2), tuple(whole)))
        if self.least:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges that windows cover, and the ids of the items whose windows occur."""
        ranges, found = [], set()
        if not self.least or len(words) < self.least:
            return ranges, found
        w, get = self.window, self.numbers.get
        known = np.full(len(words) + 2 * w, OUTSIDE, np.int64)
        known[w:-w] = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff((known > 0).astype(np.int8))) + 1
        reach = w - self.piece
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.least:
                continue
            for end, (length, places, whole) in self.automaton.iter(tuple(known[a:b].tolist())):
                begin = a + end - length + 1
                for k in whole:
                    ranges.append((begin - w, begin - w + length))
                    found |= self.ids[k]
                if len(places):
                    at = places[:, 0, None]
                    before = self.flat[at - np.arange(1, reach + 1)] == known[begin - reach : begin][::-1]
                    after = self.flat[at + length + np.arange(reach)] == known[begin + length : begin + length + reach]
                    left = np.logical_and.accumulate(before, axis=1).sum(axis=1)
                    right = np.logical_and.accumulate(after, axis=1).sum(axis=1)
                    for i in np.flatnonzero(left + right + length >= w).tolist():
                        ranges.append((int(begin - w - left[i]), int(begin - w + length + right[i])))
                        found |= self.ids[places[i, 1]]
        return ranges, found


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code point offsets (end exclusive) in the original text."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(C.NORMAL_BYTES))]
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(point[places[a][0]]), "end": int(point[places[b - 1][1]])} for a, b in ranges]


def mark_hits(docs: DataFrame, items: DataFrame, into: str, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All columns of docs, whatever their names, and the struct `into` of n_words, n_hit (words in
    an occurrence of a window), item_ids (sorted as strings) and spans (code points of the
    original text, merged).

    Words: maximal runs of a-z, 0-9 and non-ASCII after lower-casing A-Z. A window is
    `window` consecutive words of an item, or the whole of a shorter item.

    Null or empty texts have no words and no hits; an item without words occurs nowhere; an
    item with a null id marks words but is not listed. Repeated rows of docs give repeated
    results; repeated item ids count once. Very long texts are scanned whole, one at a time.
    Where windows tie or overlap, each word counts once. Empty tables give no rows or no hits.
    Only the items reach the driver, in blocks of `automaton_bytes` (by a hash of the text).
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // automaton_bytes) or 1
    shipped = []
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        shipped.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r.i, r.t.encode()) for r in part.toLocalIterator()])))

    def scan(texts: list[bytes]) -> list[pa.Array]:
        split = [t.translate(C.NORMAL_BYTES).split() for t in texts]
        ranges: list[list] = [[] for _ in texts]
        ids: list[set] = [set() for _ in texts]
        for key, sent in shipped:
            own = C.loaded(key, sent, lambda x: Items(x, window))
            for i, words in enumerate(split):
                found, names = own.scan(words)
                ranges[i] += found
                ids[i] |= names
        merged = [_merge(r) for r in ranges]
        return [
            pa.array([len(w) for w in split], pa.int64()),
            pa.array([sum(b - a for a, b in m) for m in merged], pa.int64()),
            pa.array([sorted(x for x in s if x is not None) for s in ids], pa.list_(pa.string())),
            pa.array([_offsets(t, m) if m else [] for t, m in zip(texts, merged)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]

    return C.with_struct(docs, "decontaminate", text_col, into, KIND, scan, C.SLICE_BYTES if blocks == 1 else GROUP_BYTES)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of docs: doc_id (as it is), n_words, n_hit, item_ids and spans; see mark_hits. Extra
    columns are not read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mark_hits(own, items, "hits", **options).select("doc_id", "hits.*")


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    hits = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "item_ids"), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
