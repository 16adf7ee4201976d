"""Language-model scores with a log-frequency Bloom filter.

The filter holds, for each word pair with its count quantised to the steps 1, 2, 3, 4, 6, 9 and
so on (each half as large again), one event for each step up to that count; a count is read back
by probing the pair for step after step until a probe fails. With q the step that a count is read
back as, c(v) the count of v, and D a discount, the model is

    P(w | v) = (q(v w) - D) / c(v) + left(v) * P(w),    P(w) = (c(w) + 1) / (N + V + 1).

left(v) is what the quantised counts of v's pairs leave of 1, so the probabilities of all next
words add up to 1 (but for false events). All pairs are in the filter, those seen once with one event.

Pairs are dealt into cells by their first word and, so that no frequent word fills one, by the
pair itself; a cell has its own part of the filter, and tells what its pairs take from each first
word. Word counts are sorted hash arrays. There are so many cells that each stands for
CELL_BYTES of text, whatever the input. Cells and words go to the workers in shards of bounded
size, which a worker goes through one at a time: a model that fits one shard stays
loaded, a larger one costs more passes over a batch, not more memory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of the filter, and of the words, that a worker holds at a time.
SHARD_BYTES = 32 << 20
#: Bytes of training text for each cell.
CELL_BYTES = 16 << 20
#: Bytes of text that are scored at a time; the second where each shard is loaded anew for them.
SCORED_BYTES, SCORED_BYTES_SHARDED = 2 << 20, 8 << 20
#: Taken off each pair's count.
DISCOUNT = 0.5
#: Probes for an event, and bits of filter for each event (a false event in 300).
PROBES, BITS = 8, 12


def _steps(ratio: float = 1.5) -> np.ndarray:
    out = [1]
    while out[-1] < 2**61:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


#: What counts are quantised to, downwards.
STEPS = _steps()

END = np.uint64(0xD6E8FEB86659FD93)  # the token that ends a text; no word's hash is set to it


class Layout:
    """Groups are ranges of a word's hash, so that groups in order hold sorted hashes; each has as
    many cells as salts."""

    def __init__(self, text_bytes: int, cell_bytes: int):
        cells = max(8, -(-text_bytes // cell_bytes))
        self.salts = max(2, math.isqrt(cells) // 2)
        self.groups = -(-cells // self.salts)
        self.cells = self.groups * self.salts

    def group(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.groups) >> np.uint64(32)).astype(np.int64)

    def cell(self, before: np.ndarray, names: np.ndarray) -> np.ndarray:
        return self.group(before) * self.salts + (names % np.uint64(self.salts)).astype(np.int64)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with END last, and the numbers of tokens."""
    h, counts = C.word_hashes([t.translate(C.LOWER_BYTES) for t in texts])
    counts = counts + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    ends = np.cumsum(counts) - 1
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = h
    return out, counts


def pairs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (END before a text's first one) and the name of the two."""
    before = np.concatenate(([END], tokens[:-1])).astype(np.uint64)
    return before, C.mix64(before * np.uint64(C.MIX_A) + C.mix64(tokens + np.uint64(C.GOLDEN)))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None, also: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted keys, their counts (1 each, or those given) added up, and what goes with each key."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        n = np.diff(np.append(first, len(keys)))
    else:
        n = np.add.reduceat(counts[order], first) if len(first) else counts
    return (keys[first], n) if also is None else (keys[first], n, also[order[first]])


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays))


def _arrays(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: part: a cell, or from `cells` on a group of words.
COUNTS = "part int, n long, data binary"
#: kind 0: a cell's part of the filter; 1: what a cell's pairs take from words of a group; 2: counts of words.
PARTS = "kind int, at int, n long, bits long, data binary"
WORDS = "at int, tokens long, types long, data binary"
#: Tokens that a task gathers before it adds up and sends their counts.
GATHER = 1_500_000


def _rows(rows: list[tuple], schema: str, kinds: tuple) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in schema.split(", ")]
    for at in range(0, len(rows), 16):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 16]), kinds)], names=names)


def count_ngrams(texts: DataFrame, layout: Layout) -> DataFrame:
    """Counts of words and pairs, added up within each task: a row per cell or group and task."""

    def send(tokens: np.ndarray, before: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, n_words = _summed(tokens)
        pairs, n_pairs, firsts = _summed(names, also=before)  # a pair's name tells its first word
        cell = layout.cell(firsts, pairs)
        order = np.argsort(firsts)
        order = order[np.argsort(cell[order], kind="stable")]  # by cell, then first word, which packs well
        pairs, firsts, n_pairs = pairs[order], firsts[order], n_pairs[order]
        pair_at = np.searchsorted(cell[order], np.arange(layout.cells + 1))
        word_at = np.searchsorted(layout.group(words), np.arange(layout.groups + 1))
        rows = [(k, int(b - a), pairs[a:b].tobytes() + _blob(firsts[a:b], n_pairs[a:b])) for k, (a, b) in enumerate(zip(pair_at, pair_at[1:])) if a < b]
        rows += [(layout.cells + k, int(b - a), _blob(words[a:b], n_words[a:b])) for k, (a, b) in enumerate(zip(word_at, word_at[1:])) if a < b]
        yield from _rows(rows, COUNTS, (pa.int32(), pa.int64(), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in C.slices(batch, 0):
                tokens, _ = tokens_of(C.as_bytes(part.column(0)))
                held.append((tokens, *pairs_of(tokens)))
                n += len(tokens)
                if n >= GATHER:
                    yield from send(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if n:
            yield from send(*(np.concatenate(x) for x in zip(*held)))

    return texts.mapInArrow(C.tidy("lm", run), COUNTS)


def _hashes(names: np.ndarray, step: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    a = C.mix64(names + np.asarray(step).astype(np.uint64) * np.uint64(C.GOLDEN))
    return a, C.mix64(a ^ np.uint64(C.MIX_B)) | np.uint64(1)


def cell_filter(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """What each pair's count is read back as, and the cell's filter with its number of bits."""
    steps = np.searchsorted(STEPS, counts, "right")
    names = np.repeat(pairs, steps)
    step = np.arange(len(names)) - np.repeat(np.cumsum(steps) - steps, steps)
    n_bits = max(64, -(-len(names) * BITS // 64) * 64)
    bits = np.zeros(n_bits, bool)
    a, b = _hashes(names, step)
    for i in range(PROBES):
        bits[((a + np.uint64(i) * b) % np.uint64(n_bits)).astype(np.int64)] = True
    return STEPS[steps - 1], np.packbits(bits, bitorder="little"), n_bits


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows by their first column, by which they come sorted."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = next(iter(row.values()))
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _reduce_parts(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for part, rows in _grouped(batches):
        if part < layout.cells:
            own = [(np.frombuffer(r["data"], "<u8", r["n"]), *_arrays(r["data"][8 * r["n"] :], r["n"], "<u8", "<i8")) for r in rows]
            rows.clear()
            pairs, firsts, n = (np.concatenate(x) for x in zip(*own))
            own.clear()
            pairs, n, firsts = _summed(pairs, n, firsts)
            order = np.argsort(firsts)
            pairs, n, firsts = pairs[order], n[order], firsts[order]
            read, bits, n_bits = cell_filter(pairs, n)
            at = np.flatnonzero(np.concatenate(([True], firsts[1:] != firsts[:-1])))
            taken = np.add.reduceat(read - DISCOUNT, at)
            out = [(0, part, len(pairs), n_bits, bits.tobytes()), (1, part // layout.salts, len(at), 0, _blob(firsts[at], taken))]
        else:
            own = [_arrays(r["data"], r["n"], "<u8", "<i8") for r in rows]
            words, n = _summed(*(np.concatenate(x) for x in zip(*own)))
            out = [(2, part - layout.cells, len(words), 0, _blob(words, n))]
        yield from _rows(out, PARTS, kinds)


def _reduce_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's words, their counts, and what their pairs leave of 1."""
    for at, rows in _grouped(batches):
        words, n = next(_arrays(r["data"], r["n"], "<u8", "<i8") for r in rows if r["kind"] == 2)
        taken = np.zeros(len(words))
        for r in rows:
            if r["kind"] == 1:
                firsts, own = _arrays(r["data"], r["n"], "<u8", "<f8")
                taken[np.searchsorted(words, firsts)] += own
        yield from _rows([(at, int(n.sum()), len(words), _blob(words, n, (1 - taken / n).astype(np.float32)))], WORDS, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))


class Words:
    """The words of some neighbouring groups: sorted hashes, counts, and what is left."""

    def __init__(self, rows: list[tuple]):
        n = sum(r[1] for r in rows)
        self.words, self.counts, self.left = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.float32)
        at = 0
        while rows:  # one group at a time, so that nothing is held twice
            _, types, data = rows.pop(0)
            self.words[at : at + types], self.counts[at : at + types], self.left[at : at + types] = _arrays(data, types, "<u8", "<i8", "<f4")
            at += types

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are here, and their counts and what is left of 1."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        found = self.words[at] == words
        return found, self.counts[at[found]], self.left[at[found]]


class Filter:
    """The filter of some cells."""

    def __init__(self, rows: list[tuple], cells: int):
        self.bits = np.empty(sum(r[1] for r in rows) // 8, np.uint8)
        self.n_bits, self.begin = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        at = 0
        while rows:
            cell, n_bits, data = rows.pop(0)
            self.bits[at // 8 : (at + n_bits) // 8] = np.frombuffer(data, np.uint8)
            self.n_bits[cell], self.begin[cell] = n_bits, at
            at += n_bits

    def steps(self, cell: np.ndarray, names: np.ndarray) -> np.ndarray:
        """For how many steps each pair is in the filter."""
        out, live, step = np.zeros(len(names), np.int64), np.arange(len(names)), 0
        while len(live):
            size, begin = self.n_bits[cell[live]].astype(np.uint64), self.begin[cell[live]]
            a, b = _hashes(names[live], step)
            for i in range(PROBES):
                bit = begin + ((a + np.uint64(i) * b) % size).astype(np.int64)
                ok = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                live, size, begin, a, b = live[ok], size[ok], begin[ok], a[ok], b[ok]
            step += 1
            out[live] = step
        return out


def _shards(sizes: list, most: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of places whose bytes stay below `most`, or single places; sizes: (place, bytes)."""
    out, held = [], 0
    for at, n in sizes:
        if not out or held + n > most:
            out.append([at, at])
            held = 0
        out[-1][1] = at
        held += n
    return [tuple(x) for x in out]


SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, shard_bytes: int = SHARD_BYTES, cell_bytes: int = CELL_BYTES, with_tokens: bool = False) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; if
    asked for, token_scores too, the log10 probability of each token.

    Learns from the rows whose crc32(id as text) modulo `folds` is not `held_out`. A text is
    its words (anything but ASCII blanks, A-Z in lower case) and an end. base_score is that of the
    add-one word model; score is log10 of the product of P(token | token before), of which an
    end stands before the first one.

    Null and empty texts are an end alone; a null id counts as the empty text in crc32, and stays null.
    Repeated rows count each time and are scored alike; very long texts are scored whole. Extra
    columns are not read. An empty table gives no rows; with no row to learn from, all counts are 0
    and all scores log10(1). Counts cover all rows to learn from, and all their pairs.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.pmod(C.crc32_of_id(id_col), F.lit(folds)) == held_out).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    layout = Layout(C.text_bytes(train), cell_bytes)
    parts = layout.cells + layout.groups
    # Four partitions for each part, so that few parts meet in one; adaptive execution joins small ones.
    counted = count_ngrams(train, layout).repartition(4 * parts, "part").sortWithinPartitions("part")
    made = scratch.save(counted.mapInArrow(C.tidy("lm", lambda batches: _reduce_parts(batches, layout)), PARTS), "parts")
    by_group = made.where("kind > 0").select("at", "kind", "n", "data").repartition(4 * layout.groups, "at").sortWithinPartitions("at")
    words = scratch.save(by_group.mapInArrow(C.tidy("lm", _reduce_words), WORDS), "words")
    total = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_tokens, n_types = int(total[0]), int(total[1])
    filters = made.where("kind = 0").select("at", "bits", "data")
    sent: list[list[tuple]] = []
    for df, size in ((words.select("at", "types", "data"), F.col("types") * 20), (filters, F.col("bits") / 8)):
        sizes = [tuple(r) for r in df.select("at", size).orderBy("at").collect()]  # a row per group or cell
        own = []
        for a, b in _shards(sizes, shard_bytes):
            got = sorted(tuple(r) for r in df.where(F.col("at").between(a, b)).toLocalIterator())
            own.append((uuid.uuid4().hex, spark.sparkContext.broadcast(got)))
            got.clear()  # the driver holds one shard at a time
            C.give_back()
        sent.append(own)
    scratch.drop_all_but()  # the shards have been sent
    of_words, of_cells = sent
    whole = SCORES.format(id=docs.schema[id_col].dataType.simpleString()) + ", token_scores array<double>" * with_tokens
    most = SCORED_BYTES if max(map(len, sent)) < 2 else SCORED_BYTES_SHARDED

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, sizes = tokens_of(C.as_bytes(part.column(1)))
        types, place = np.unique(tokens, return_inverse=True)
        place = place.astype(np.int32)
        count, left = np.zeros(len(types), np.int64), np.ones(len(types))
        for key, b in of_words:
            found, n, rest = C.loaded(key, b, Words, "words").look_up(types)
            count[found], left[found] = n, rest
        before, names = pairs_of(tokens)
        names, at, which = np.unique(names, return_index=True, return_inverse=True)
        cell, steps = layout.cell(before[at], names), np.zeros(len(names), np.int64)
        for key, b in of_cells:
            own = C.loaded(key, b, lambda x: Filter(x, layout.cells), "cells")
            here = np.flatnonzero(own.n_bits[cell] > 0)
            steps[here] = own.steps(cell[here], names[here])
        c = count[place]
        first = np.concatenate(([np.searchsorted(types, END)], place[:-1]))  # before the first token of a text stands an end
        cv = count[first]
        read = np.where(steps > 0, STEPS[steps - 1] - DISCOUNT, 0.0)[which]
        alone = np.log10(c + 1.0) - np.log10(float(n_tokens + n_types + 1))
        both = np.log10(np.minimum(1.0, np.where(cv > 0, read / np.maximum(cv, 1), 0.0) + left[first] * 10.0**alone))
        starts = C.starts_of(sizes)
        cols = [part.column(0), part.column(2), pa.array(sizes), *(pa.array(np.add.reduceat(x, starts[:-1])) for x in ((c > 0).astype(np.int64), alone, both))]
        if with_tokens:
            cols.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(both)))
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in whole.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, 1, most, 4000 if most == SCORED_BYTES else 1 << 30):
                yield score(part)

    out = rows.mapInArrow(C.tidy("lm", run), whole)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score", *(["token_scores"] if with_tokens else []))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.table(spark, sf_dir, "documents"))
