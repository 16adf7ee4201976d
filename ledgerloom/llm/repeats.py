"""Substring deduplication by recompression.

Rounds name runs of equal words and then pairs of neighbouring symbols; a name is a hash
of what it stands for, so all tasks give equal substrings equal names without asking each
other: a dictionary made by a shuffle in each round would give the same names, but deal out
all symbols of the corpus each time. Whether two neighbours become a pair depends on the two
alone (the first must be a left symbol and the second a right one, by a bit of their hashes), so a
passage that two documents share is cut alike in both but for one symbol at each end in each round.

With two rounds of pairs, a window of 50 words without an immediate repetition has 11
symbols or more that are cut alike wherever it occurs: the run at its edge takes one word,
the first round one, the second two, on either side; 42 words are left, in symbols of four
at most. Of any 7 neighbouring symbols the one with the least hash is an anchor, and its
high-level name is that of it and two symbols on both sides. So each such window holds an
anchor that all its occurrences share. Windows that hold a shared anchor, and those with
an immediate repetition, are candidates; they are matched by a 64-bit name of their words.

All matches together are then verified by other hashes of the same words: each window that
is removed adds its second name, and each that it was matched with takes its own off. The sum over
the corpus is zero modulo 2^64 if all are equal, and else with a probability of 2^-64, however
many windows there are; where it is not, all is done again with other hashes.

What a task can settle among its own documents it settles; for each name only its
smallest document goes to the shuffle, so a passage that a third of all documents hold
costs one entry a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agg as A
from . import common as C

WINDOW = 50
ROUNDS, NEIGHBOURS, AROUND = 2, 7, 2
#: Entries that a task gathers before it settles and sends them.
GATHER = 3_000_000
#: Bytes of text for each bucket that names are dealt into.
BUCKET_BYTES = 16 << 20

ENTRIES = "bucket int, sent binary"


def name_runs(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where they start and their documents after runs of equal words have got names."""
    if not len(x):
        return x, np.empty(0, np.int64), doc
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (doc[1:] != doc[:-1]))))
    length = np.diff(np.append(first, len(x)))
    y = x[first].copy()
    run = length > 1
    y[run] = C.mix64(y[run] * np.uint64(C.GOLDEN) + length[run].astype(np.uint64))
    return y, first, doc[first]


def name_pairs(x: np.ndarray, start: np.ndarray, doc: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after each left symbol has joined a right one that follows it."""
    if len(x) < 2:
        return x, start, doc
    left = (C.mix64(x + np.uint64(turn)) & np.uint64(1)).astype(bool)
    pair = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
    y = x.copy()
    at = np.flatnonzero(pair)
    y[at] = C.mix64(x[at] * np.uint64(C.MIX_A) + C.mix64(x[at + 1] + np.uint64(C.GOLDEN + turn)))
    keep = np.concatenate(([True], ~pair))
    return y[keep], start[keep], doc[keep]


def anchors(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of anchors, their documents (numbers), and the words (from, to; in h) that they span."""
    x, start, doc = name_runs(h, np.repeat(np.arange(len(counts)), counts))
    for turn in range(ROUNDS):
        x, start, doc = name_pairs(x, start, doc, turn + 1)
    n = len(x)
    if n < NEIGHBOURS + 2 * AROUND:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    rank = C.mix64(x ^ np.uint64(C.MIX_B))
    least = np.lib.stride_tricks.sliding_window_view(rank, NEIGHBOURS).argmin(axis=1) + np.arange(n - NEIGHBOURS + 1)
    whole = doc[: n - NEIGHBOURS + 1] == doc[NEIGHBOURS - 1 :]
    at = np.unique(least[whole])
    at = at[(at >= AROUND) & (at + AROUND < n)]
    at = at[(doc[at - AROUND] == doc[at]) & (doc[at + AROUND] == doc[at])]
    end = np.append(start[1:], len(h))
    names = C.chain_hash(x, 2 * AROUND + 1)[at - AROUND]
    return names, doc[at], start[at - AROUND], end[at + AROUND]


def window_names(h: np.ndarray, width: int) -> np.ndarray:
    """Names of all windows of `width` entries, put together from those of powers of two."""
    n = len(h) - width + 1
    power, size, out, at = h, 1, None, 0
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            part = power[at : at + n]
            out = C.mix64(part + np.uint64(C.GOLDEN)) if out is None else C.mix64(out * np.uint64(C.MIX_B) + part)
            at += size
        if width >> (bit + 1):
            power = C.mix64(power[:-size] * np.uint64(C.MIX_A) + C.mix64(power[size:] + np.uint64(C.GOLDEN + size)))
            size *= 2
    return out


def _packed(names: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    raw = b"".join((doc.astype("<i8").tobytes(), a.astype("<u4").tobytes(), b.astype("<u4").tobytes()))
    return names.astype("<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(count: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data[8 * count :])
    return np.frombuffer(data, "<u8", count), np.frombuffer(raw, "<i8", count), np.frombuffer(raw, "<u4", count, 8 * count), np.frombuffer(raw, "<u4", count, 12 * count)


def _rows(names, doc, a, b, buckets: int, settled: bool) -> Iterator[pa.RecordBatch]:
    """Entries by bucket: a mark (settled or not), their number, then the packed columns."""
    bucket = (names >> np.uint64(32)).astype(np.int64) % buckets
    order = np.lexsort((names, bucket))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    ks = [k for k in range(buckets) if cut[k] < cut[k + 1]]
    sent = []
    for k in ks:
        own = order[cut[k] : cut[k + 1]]
        sent.append(bytes([settled]) + len(own).to_bytes(8, "little") + _packed(names[own], doc[own], a[own], b[own]))
    for at in range(0, len(ks), 32):
        yield pa.RecordBatch.from_arrays([pa.array(ks[at : at + 32], pa.int32()), pa.array(sent[at : at + 32], pa.binary())], names=["bucket", "sent"])


def _settle_shared(names, doc, a, b, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors: names that two documents of a task have are shared, and one entry tells others so."""
    order = np.lexsort((doc, names))
    names, doc, a, b = names[order], doc[order], a[order], b[order]
    first = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(names)) - 1
    shared = (doc[at] != doc[last])[group]
    if shared.any():
        yield from _rows(names[shared], doc[shared], a[shared], b[shared], buckets, True)
    if (~shared).any():
        yield from _rows(names[~shared], doc[~shared], a[~shared], b[~shared], buckets, False)


def _firsts(names, doc, a) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by name, document and start; in that order, which entries are of a later document than
    the first of their name; and the places of first entries that have later ones, with their number."""
    order = np.lexsort((a, doc, names))
    names, doc = names[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
    size = np.diff(np.append(at, len(names)))
    later = doc != np.repeat(doc[at], size)
    n = np.add.reduceat(later.astype(np.int64), at) if len(at) else at
    return order, later, at[n > 0], n[n > 0]


def _settle_first(names, doc, a, b, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows: where a task has a smaller document with the same name, that is settled (length 0),
    and the smallest one's entry counts those matched with it (length: their number); the
    smallest one's windows are sent to be compared."""
    order, later, first, n = _firsts(names, doc, a)
    names, doc, a = names[order], doc[order], a[order]
    if len(first):
        done = np.concatenate((np.flatnonzero(later), first))
        yield from _rows(names[done], doc[done], a[done], np.concatenate((np.zeros(later.sum(), np.int64), n)), buckets, True)
    if (~later).any():
        yield from _rows(names[~later], doc[~later], a[~later], b[order][~later], buckets, False)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """For each bucket, its settled and its open entries; rows come sorted by bucket."""
    key, held = None, ([], [])
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key:
                if key is not None:
                    yield held
                key, held = k, ([], [])
            raw = data.as_py()
            held[not raw[0]].append(_unpacked(int.from_bytes(raw[1:9], "little"), raw[9:]))
    if key is not None:
        yield held


def _joined(parts: list) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32))


def _by_doc(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """A row per document: the (from, length) pairs that a bucket has for it."""
    if not len(doc):
        return None
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    offsets = pa.array(np.append(at, len(doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), *lists], names=["id", "starts", "lengths"])


FOUND = "id long, starts array<int>, lengths array<int>"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for settled, waiting in _grouped(batches):
        names, doc, a, b = _joined(waiting)
        known = np.unique(_joined(settled)[0])
        _, number = np.unique(names, return_inverse=True)
        lo, hi = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(lo, number, doc)
        np.maximum.at(hi, number, doc)
        yes = (lo[number] < hi[number]) | np.isin(names, known)
        more = _joined(settled)
        out = _by_doc(np.concatenate((doc[yes], more[1])), np.concatenate((a[yes], more[2])), np.concatenate((b[yes], more[3])))
        if out is not None:
            yield out


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for settled, waiting in _grouped(batches):
        names, doc, a, _ = _joined(waiting)
        order, later, first, n = _firsts(names, doc, a)
        doc, a, more = doc[order], a[order], _joined(settled)
        out = _by_doc(np.concatenate((doc[later], doc[first], more[1])), np.concatenate((a[later], a[first], more[2])), np.concatenate((np.zeros(later.sum(), np.int64), n, more[3])))
        if out is not None:
            yield out


def _candidates(h: np.ndarray, starts: list | None, lengths: list | None, width: int) -> np.ndarray:
    """First words of a document's windows that hold a shared anchor or an immediate repetition."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    change = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(h[1:] == h[:-1])
    lo, hi = [np.maximum(twice + 2 - width, 0)], [np.minimum(twice, n - 1)]
    if starts is not None:
        s, e = np.array(starts, np.int64), np.array(starts, np.int64) + np.array(lengths, np.int64)
        lo.append(np.maximum(e - width, 0))
        hi.append(np.minimum(s, n - 1))
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    ok = lo <= hi
    np.add.at(change, lo[ok], 1)
    np.add.at(change, hi[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def _stream(parts, settle, buckets: int) -> Iterator[pa.RecordBatch]:
    """Settles and sends entries (names, documents, from, length) whenever enough are gathered."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GATHER:
            yield from settle(*(np.concatenate(x) for x in zip(*held)), buckets)
            held, n = [], 0
    if n:
        yield from settle(*(np.concatenate(x) for x in zip(*held)), buckets)


FINISHED = "doc_id long, n_words long, n_removed long, removed_from array<int>, removed_to array<int>, kept string, differ long"


def _finish(text: bytes, starts: list, numbers: list, width: int, seed: int) -> tuple:
    """A text's numbers of words and of removed ones, their ranges, what is left, and what its windows
    add to the sum that verifies the matches (modulo 2^64)."""
    words = text.split()
    ranges, kept, at = [], [], 0
    for s in sorted(s for s, n in zip(starts, numbers) if not n):
        if ranges and s <= ranges[-1][1]:
            ranges[-1][1] = s + width
        else:
            ranges.append([s, s + width])
    for a, b in ranges:
        kept += words[at:a]
        at = b
    kept += words[at:]
    differ = 0
    if starts:
        h, _ = C.word_hashes([text], seed)
        n = np.array(numbers, np.int64)
        names = window_names(h, width)[np.array(starts)]
        differ = int((names * np.where(n == 0, np.uint64(1), (-n).view(np.uint64))).sum().view(np.int64))
    return len(words), len(words) - len(kept), [a for a, _ in ranges], [b for _, b in ranges], b" ".join(kept).decode("utf-8", "surrogatepass"), differ


def repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, removed_from and removed_to (arrays of starts and
    ends of the covered words' ranges) and kept (the text that is left, words joined by one blank).

    A word is removed if a window of `width` words that covers it also starts in a document
    with a smaller id; all windows are judged on the input. Words: runs of anything but
    ASCII blanks. Null and empty texts have no words and keep the empty text. A row with a
    null id is left as it is and makes no others shorter. Repeated rows do not remove each
    other; of different texts under one id, that with the smaller digest counts as the smaller
    one, and ids of other types than numbers are compared as they sort. Very long texts are
    judged whole. An empty table gives no rows. Extra columns are not read.
    """
    if width < WINDOW:
        raise ValueError(f"two rounds guarantee a shared anchor from windows of {WINDOW} words on")
    rows, keys = C.key_rows(docs, id_col, text_col)
    scratch = C.Scratch(docs.sparkSession, "repeats")
    buckets = max(64, -(-C.text_bytes(rows) // bucket_bytes))
    for turn in range(8):
        done = scratch.save(_judged(rows, width, buckets, seed + 2 * turn), f"turn{turn}")
        if done.agg(A.total("differ").alias("d")).first()["d"] == 0:
            done = done.drop("differ")
            if keys is None:
                return done
            each = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long"))))
            named = done.join(keys.select("_id", F.col("doc_id").alias("_key"), "n"), F.col("doc_id") == F.col("_key"), "left").withColumn("_row", each)
            return named.select(F.col("_id").alias("doc_id"), *done.columns[1:])
        scratch.drop(f"turn{turn}")
    raise RuntimeError("windows of different words got equal names eight times over")


def _judged(rows: DataFrame, width: int, buckets: int, seed: int) -> DataFrame:
    """The result of repeated_words, with one choice of hashes, and each row's share of the check."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for part in C.slices(batch, 1, 1 << 20, 256):
                    h, counts = C.word_hashes(C.as_bytes(part.column(1)), seed)
                    names, doc, a, b = anchors(h, counts)
                    begin = C.starts_of(counts)
                    yield names, part.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64), a - begin[doc], b - a

        yield from _stream(parts(), _settle_shared, buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in C.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small.compress(t) for t in C.as_bytes(part.column(1))], pa.binary())], names=["doc_id", "z"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
        """Ids, texts, starts and numbers of a few rows at a time."""
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in C.slices(batch, 1, 1 << 19, 256):
                yield part.column(0).to_pylist(), [large.decompress(z) for z in part.column(1).to_pylist()], part.column(2).to_pylist(), part.column(3).to_pylist()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for ids, texts, spans, lengths in unpacked(batches):
                h, counts = C.word_hashes(texts, seed)
                begin = C.starts_of(counts)
                own = [_candidates(h[begin[i] : begin[i + 1]], spans[i], lengths[i], width) for i in range(len(ids))]
                own = [x if i is not None else x[:0] for i, x in zip(ids, own)]
                sizes = np.array([len(x) for x in own])
                if sizes.sum():
                    starts = np.concatenate(own)
                    names = window_names(h, width)[starts + np.repeat(begin[:-1], sizes)]
                    yield names, np.repeat(np.array([i or 0 for i in ids], np.int64), sizes), starts, np.ones(len(starts), np.int64)

        yield from _stream(parts(), _settle_first, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64())
        for ids, texts, starts, numbers in unpacked(batches):
            out = [_finish(t, s or [], n or [], width, seed + 1) for t, s, n in zip(texts, starts, numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], names=[x.split()[0] for x in FINISHED.split(", ")])

    def by_document(entries: DataFrame, reduce) -> DataFrame:
        # Four partitions for each bucket, so that few buckets meet in one.
        found = entries.repartition(4 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidy("repeats", reduce), FOUND)
        return found.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"))

    # Both joins deal out the same rows by id, so that Spark shuffles the texts once.
    texts = rows.mapInArrow(C.tidy("repeats", pack), "doc_id long, z binary")
    shared = by_document(rows.where("doc_id IS NOT NULL").mapInArrow(C.tidy("repeats", find), ENTRIES), _shared)
    looked = C.left_join(texts, shared.hint("shuffle_hash"), "doc_id", "id", "z").select("doc_id", "z", "starts", "lengths")
    removed = by_document(looked.mapInArrow(C.tidy("repeats", windows), ENTRIES), _later)
    out = C.left_join(texts, removed.hint("shuffle_hash"), "doc_id", "id", "z").select("doc_id", "z", "starts", "lengths")
    return out.mapInArrow(C.tidy("repeats", finish), FINISHED)


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_words(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP10_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS k, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS m
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
f AS (SELECT k, m, min(doc_id) AS first FROM v GROUP BY 1, 2),
r AS (SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + {WINDOW})) AS p FROM v JOIN f USING (k, m) WHERE v.doc_id > f.first),
a AS (SELECT w.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM w, LATERAL (SELECT unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p) t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND r.p = t.p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(a.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""
