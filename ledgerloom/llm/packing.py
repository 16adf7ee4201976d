"""Best-fit packing of tokenised documents: hierarchical residual packing.

Partitions pack their own pieces best-fit, by decreasing length. Bins that are nearly
full leave at once; underfull bins become items themselves, and a tree of fewer and
fewer partitions packs those again, whole bins at a time, until one partition is left.
Where the underfull bins are too many for one, further rounds deal them out anew until
that no longer helps.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
#: A bin with no more room than this is final at once (0.4 % of a sequence).
NEARLY_FULL = 8
#: Partitions that meet in one at each level of the tree.
FAN_IN = 8
#: Underfull bins that one task may get. Where more are left, the tree ends in several roots.
ROOT_BINS = 400_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = "bin long, filled int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"

#: How byte-level BPE cuts a text before it merges bytes (fixed value: the published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves,
    the others by their order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids (little-endian uint32) of texts by a byte-level BPE file of `tokenizers`.

    Two programs give the same ids for the same vocabulary and merges. `tiktoken` is the faster one
    and takes texts of letters up to U+024F without long white space, where both agree on
    what a letter, a digit and a blank is; `tokenizers` takes all others, texts that spell out an
    added token, and all texts if the file is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        odd = "|".join([*map(re.escape, sorted(added, key=len, reverse=True)), r"[^\x00-\u024f]", r"\s{300}"])
        self.odd, self.fast = re.compile(odd).search, self._fast(path)

    @staticmethod
    def _fast(path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cut = said["model"], said.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said.get("normalizer")
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None  # ids that do not tell the order of merges
        import tiktoken

        of = _byte_of()
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.fast is None or self.odd(t):
                out.append(np.array(self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes())
            else:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes())
        return out


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then `end_id`; one longer than `capacity` is cut into pieces
    of `capacity`, of which the first may be shorter. Ids are those of the tokenizer with
    add_special_tokens=False: an added token that a text spells out is that token. Null and
    empty texts are the end alone. Repeated rows give repeated pieces. Very long texts are
    encoded whole. Extra columns are not read; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = C.kept(tokenizer_path, lambda: Encoder(tokenizer_path)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in C.slices(batch, 1, rows=500):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, got in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    got += end
                    n = len(got) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = got[4 * a : 4 * b]
                        doc.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(C.whole_ids(docs, id_col), F.col(text_col).alias("text")).mapInArrow(C.tidy("packing", run), PIECE + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and how full each bin is.

    Bins wait in stacks by the room they have left; a number's bits tell which stacks
    hold any, so the tightest bin that fits is its lowest bit from the item's size up.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits, filled = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = open_bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_bits ^= 1 << room
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if room > size:
            stacks[room - size].append(b)
            open_bits |= 1 << (room - size)
    return bins, offsets, np.array(filled, np.int64)


def _bins_of(tables: Iterator[pa.Table], level: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Packs what a task has read: columns filled and members (an array of pieces)."""
    base = (level << 56) + (TaskContext.get().partitionId() << 32)
    made = 0
    for got in tables:
        bins, offsets, filled = best_fit(got.column("filled").to_numpy().astype(np.int64), capacity)
        members = got.column("members").combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = members.chunk(0)
        lists = np.diff(members.offsets.to_numpy())
        order = np.argsort(np.repeat(bins, lists), kind="stable")
        flat = members.flatten()
        shift = np.repeat(offsets, lists)
        fields = {f.name: flat.field(f.name) for f in MEMBER}
        fields["offset"] = pa.array(fields["offset"].to_numpy() + shift, pa.int64())
        ordered = pa.StructArray.from_arrays([fields[f.name] for f in MEMBER], fields=list(MEMBER)).take(pa.array(order))
        counts = np.zeros(len(filled), np.int64)
        np.add.at(counts, bins, lists)
        out = pa.ListArray.from_arrays(pa.array(C.starts_of(counts), pa.int32()), ordered)
        ids = base + made + np.arange(len(filled))
        made += len(filled)
        for at in range(0, len(filled), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 5000], pa.int64()), pa.array(filled[at : at + 5000], pa.int32()), out.slice(at, 5000)], names=["bin", "filled", "members"])


def _gather(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's batches together, `rows` at most at a time, so that memory is bounded."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def best_fit_pack(pieces: DataFrame, *, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN, root_bins: int = ROOT_BINS) -> DataFrame:
    """Sequences for pieces (doc_id, piece, start, length, ids_crc32; 1 <= length <= capacity).

    Adds sequence_id and offset; the pieces of a sequence lie without gaps from 0. Pieces of one
    length go in the order in which a task reads them; of bins with equal room, the last one
    opened is filled first. Other columns of pieces are not read. Each level is written to the shared folder before the next reads it, so that a lost
    executor cannot change a packing that others have used. No rows give no rows.
    """
    spark = pieces.sparkSession
    scratch = C.Scratch(spark, "packing")
    members = F.array(F.struct(*(F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), F.lit(0).cast("long").alias("offset")))
    items = pieces.select(F.col("length").cast("int").alias("filled"), members.alias("members"))
    done: list[DataFrame] = []
    parts, level, was = 0, 0, 0
    while True:
        packed = scratch.save(items.mapInArrow(C.tidy("packing", lambda b, level=level: _bins_of(_gather(b, root_bins), level, capacity)), BINS), f"level{level}")
        last = parts == 1
        left = packed.where(F.col("filled") < capacity - nearly_full)
        n = 0 if last else left.count()
        before = parts or packed.rdd.getNumPartitions()
        parts = max(1, -(-before // fan_in), -(-n // root_bins))
        # Where the underfull bins are too many for fewer tasks, they are dealt anew and meet others,
        # as long as that spares one sequence in a thousand.
        if last or not n or (level and parts >= before and n > 0.999 * was):
            done.append(packed)
            break
        done.append(packed.where(F.col("filled") >= capacity - nearly_full))
        items = left.select("filled", "members").repartition(parts)
        was, level = n, level + 1
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenises docs and packs them: a row per piece with its sequence_id and offset.

    Null, empty, repeated and very long texts: see tokenize_pieces. Extra columns are not read.
    """
    return best_fit_pack(tokenize_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity), capacity=capacity)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id and its ids in order (at most `capacity`)."""
    rows = packed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
