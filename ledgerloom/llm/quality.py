"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The n-grams are of five bytes of the text, across the borders of its words (any blanks between
two words count as one): their number is bounded by the alphabets in use and not by the
corpus, every text counts, and function words, inflections and what follows what all show in
them. Five bytes fit a long, so counts are exact. Spark counts the n-grams, and the
shorter ones by the different n-grams that they end; tasks make the model, in shards that are
sorted arrays of hashed n-grams with their interpolated log probabilities and the discounts
of modified Kneser-Ney (one each for counts of one, two, and more). The texts that are judged
are those that were counted, so a text has no n-gram that the arrays lack.

Perplexity is by letter or digit: symbols and marks add to a text's surprise, but not to its
length. A language's own spread among texts of like length gives the lower and upper limit
between which texts are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of an n-gram.
ORDER = 5
#: N-grams in a shard (12 bytes each), how many shards a worker keeps at a time, and the pieces in which
#: tasks make a shard.
SHARD_GRAMS, HELD_SHARDS, PIECES = 2_000_000, 4, 64
#: The bands: so many interquartile ranges below the first and above the third quartile.
BAND_IQR = 2.0
#: The quartiles are of distances from the language's median, times the root of the number of
#: words, as short texts spread more; and of texts whose numbers of words have as many binary
#: digits. With fewer texts than this, the next sizes on both sides join them, and so on.
LEAST_TEXTS = 100
#: Log perplexities are counted in steps of this size.
STEP = 0.001
#: Bytes of text that are looked at together, and n-grams that are gathered before they are counted.
SLICE, GATHER = 1 << 20, 2_000_000

COUNTED = "lang string, gram long, n long"
BUILT = "lang string, piece int, n long, grams binary"
BASE = "doc_id {id}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_NO_LETTERS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte windows of all texts, one after another, and their number in each: that of the
    bytes of its words and a blank after each. Four blanks stand before the first word."""
    own = [b"    " + b" ".join(w) + b" " if w else b"" for w in map(bytes.split, texts)]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
    raw = np.frombuffer(b"".join(own), np.uint8)
    sizes = np.maximum(np.diff(ends, prepend=0) - (ORDER - 1), 0)
    if not len(raw):
        return np.empty(0, np.int64), sizes
    two = raw[:-1].astype(np.int32) << 8 | raw[1:]
    five = (two[:-3].astype(np.int64) << 24) | (two[2:-1].astype(np.int64) << 8) | raw[4:]
    inside = np.ones(len(five), bool)
    across = np.unique(ends[ends < len(raw)])[:, None] + np.arange(1 - ORDER, 0)
    inside[across[(across >= 0) & (across < len(five))]] = False
    return five[inside], sizes


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    return grams[at], np.diff(np.append(at, len(grams)))


def _by_lang_texts(texts: pa.Array, langs: pa.Array) -> dict[str, list[tuple[int, bytes]]]:
    """Places and texts, by language."""
    out: dict[str, list] = {}
    for i, (text, lang) in enumerate(zip(C.as_bytes(texts), langs.to_pylist())):
        out.setdefault(lang, []).append((i, text))
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all texts of rows (text, lang): added up by task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            own = _counted(np.concatenate(held.pop(lang)))
            old = sums.get(lang)
            sums[lang] = own if old is None else _summed(*(np.concatenate(x) for x in zip(old, own)))

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            keys, total = sums.pop(lang)
            for at in range(0, len(keys), 50_000):
                n = len(keys[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(keys[at : at + n]), pa.array(total[at : at + n])], names=["lang", "gram", "n"])

        for batch in batches:
            for part in C.slices(batch, 0, SLICE, 4000):
                for lang, texts in _by_lang_texts(part.column(0), part.column(1)).items():
                    held.setdefault(lang, []).append(grams_of([t for _, t in texts])[0])
                    if sum(map(len, held[lang])) > GATHER:
                        settle(lang)
                if sum(len(k) for k, _ in sums.values()) > 2 * SHARD_GRAMS:
                    for own in list(sums):
                        yield from send(own)
        for lang in list(held):
            settle(lang)
        for lang in list(sums):
            yield from send(lang)

    counted = rows.select("text", "lang").mapInArrow(C.tidy("quality", run), COUNTED)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """The discounts for counts of 0, 1, 2, 3 and more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


def _level(order: int, keys: np.ndarray, n: np.ndarray, d: np.ndarray, shorter: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams of `order` bytes (sorted, with counts n), interpolated with those of
    the n-grams without the first byte: p, of the sorted ones in shorter."""
    context = keys >> 8
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    total, off = np.add.reduceat(n, first), d[np.minimum(n, 3)]
    each = np.diff(np.append(first, len(keys)))
    own, left = np.repeat(total, each), np.repeat(np.add.reduceat(off, first) / total, each)
    return (n - off) / own + left * p[np.searchsorted(shorter, keys & ((1 << 8 * (order - 1)) - 1))]


def shard_of(middle, shards: int):
    """The shard of n-grams with these two bytes before the last one: columns or arrays."""
    return middle * 40503 % 65536 * shards // 65536


def _hashed(grams: np.ndarray) -> np.ndarray:
    return C.mix64(grams.astype(np.uint64) + np.uint64(C.GOLDEN))


def build_model(grams: DataFrame, scratch: C.Scratch, shard_grams: int) -> tuple[DataFrame, int]:
    """The model, a row for each language and piece of a shard (sorted hashes, then log probabilities),
    and how many shards there are.

    N-grams of five, four and three bytes go to the piece of the two bytes before the last one, which the
    n-grams that they are interpolated with share. Those of two and one, 65,792 at most for a
    language, and the counts of counts are known to all tasks.
    """
    spark = grams.sparkSession
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # how many different n-grams end in each shorter one
        own = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = scratch.save(own, f"grams{k}")
    ones = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    d = {(k, r["lang"]): _discounts(np.array(r[1:])) for k in range(2, ORDER + 1) for r in levels[k].groupBy("lang").agg(*ones).collect()}
    small: dict[str, list] = {}
    for k in (1, 2):
        for r in levels[k].select("lang", "gram", "n").collect():  # 256 and 65,536 at most for a language
            small.setdefault(r["lang"], [[], []])[k - 1].append((r["gram"], r["n"]))
    two = {}
    for lang, (one, pairs) in small.items():
        (k1, n1), (k2, n2) = (tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for v in (one, pairs))
        two[lang] = k2, _level(2, k2, n2, d[2, lang], k1, n1 / n1.sum())
    known = spark.sparkContext.broadcast((two, d))
    shards = max(1, -(-grams.count() // shard_grams))
    middle = F.shiftright("gram", 8).bitwiseAND(F.lit(65535))
    piece = F.shiftright(F.pmod(middle * 40503, F.lit(65536)) * (PIECES * shards), 16).cast("int")
    rows = None
    for k in (3, 4, ORDER):
        own = levels[k].select(piece.alias("piece"), "lang", F.lit(k).alias("k"), "gram", "n")
        rows = own if rows is None else rows.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, d = known.value
        held: dict[int, list] = {}
        now: tuple | None = None

        def close() -> pa.RecordBatch:
            shorter, p = two[now[1]]
            for k in (3, 4, ORDER):
                keys, n = (np.concatenate(x) for x in zip(*held[k]))
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                shorter, p = keys, _level(k, keys, n, d[k, now[1]], shorter, p)
            h = _hashed(shorter)
            order = np.argsort(h)
            data = h[order].astype("<u8").tobytes() + np.log(p[order]).astype("<f4").tobytes()
            row = (now[1], now[0], len(h), zstandard.ZstdCompressor(level=1).compress(data))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in BUILT.split(", ")])

        for batch in batches:
            s, lang, k = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (lang[1:] != lang[:-1]) | (k[1:] != k[:-1])))) if len(s) else []
            for a, b in zip(cut, [*cut[1:], len(s)]):
                if now != (int(s[a]), lang[a]):
                    if now is not None:
                        yield close()
                    now, held = (int(s[a]), lang[a]), {}
                held.setdefault(int(k[a]), []).append(tuple(batch.column(i).slice(a, b - a).to_numpy() for i in (3, 4)))
        if now is not None:
            yield close()

    dealt = rows.repartition(min(PIECES * shards, 2000), "piece").sortWithinPartitions("piece", "lang", "k")
    return scratch.save(dealt.mapInArrow(C.tidy("quality", run), BUILT), "model"), shards


def _send(spark: SparkSession, model: DataFrame, shards: int) -> list[tuple]:
    """(key, broadcast of rows of the model) for each shard: of bounded size, one by one."""
    out = []
    for k in range(shards):
        rows = [tuple(r) for r in model.where(F.floor(F.col("piece") / PIECES) == k).select("lang", "n", "grams").toLocalIterator()]
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
        rows.clear()
        C.give_back()
    return out


class Grams:
    """Sorted hashes of a language's n-grams in a shard, their log probabilities, and an index by the
    first bits of the hash: there is about one n-gram for each of its places."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order]
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """The log probabilities of n-grams, all of which are there."""
        h = _hashed(grams)
        at = self.begin[(h >> self.shift).astype(np.int32)]
        miss = np.flatnonzero(self.hashes[at] != h)
        while len(miss):
            at[miss] += 1
            miss = miss[self.hashes[at[miss]] != h[miss]]
        return self.logs[at]


def _load(rows: list[tuple]) -> dict[str, Grams]:
    held: dict[str, list] = {}
    for lang, n, data in rows:
        raw = zstandard.ZstdDecompressor().decompress(data)
        held.setdefault(lang, []).append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n, 8 * n)))
    return {lang: Grams(*(np.concatenate(x) for x in zip(*held.pop(lang)))) for lang in list(held)}


def log_p(texts: dict[str, list[tuple[int, bytes]]], n: int, sent: list[tuple]) -> np.ndarray:
    """The log probabilities of n texts, given by language with their places. Each shard is loaded once at most."""
    grams = {lang: grams_of([t for _, t in own]) for lang, own in texts.items()}
    logs = {lang: np.zeros(len(g), np.float32) for lang, (g, _) in grams.items()}
    shard = {lang: shard_of(g >> 8 & 65535, len(sent)) if len(sent) > 1 else None for lang, (g, _) in grams.items()}
    for k, (key, b) in enumerate(sent):
        if len(sent) > 1 and not any((s == k).any() for s in shard.values()):
            continue
        model = C.loaded(key, b, _load, f"shard{k % HELD_SHARDS}")
        for lang, (g, _) in grams.items():
            if len(sent) == 1:
                if len(g):
                    logs[lang] = model[lang].get(g)
                continue
            own = np.flatnonzero(shard[lang] == k)
            if len(own):
                logs[lang][own] = model[lang].get(g[own])
    out = np.zeros(n)
    for lang, (_, sizes) in grams.items():
        sums, ends = np.concatenate(([0.0], np.cumsum(logs[lang], dtype=np.float64))), C.starts_of(sizes)
        out[[i for i, _ in texts[lang]]] = sums[ends[1:]] - sums[ends[:-1]]
    return out


def _repeats(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them windows cover whose words occur twice or more in it."""
    h, counts = C.word_hashes(texts)
    covered = np.zeros(len(texts), np.int64)
    if len(h) >= width:
        doc = np.repeat(np.arange(len(texts)), counts)
        at = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :])
        name = C.mix64(C.chain_hash(h, width)[at] + doc[at].astype(np.uint64) * np.uint64(C.GOLDEN))
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + width, -1)
        covered = np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=len(texts))
    return counts, covered


def measure(rows: DataFrame, sent: list[tuple]) -> DataFrame:
    """The base measures and the log perplexity of rows (doc_id, text, lang); a text without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, 1, SLICE if len(sent) <= HELD_SHARDS else 16 * SLICE, 2000):
                texts = C.as_bytes(part.column(1))
                counts, covered = _repeats(texts)
                logs = log_p(_by_lang_texts(part.column(1), part.column(2)), len(texts), sent)
                perplexity, chars, symbols, lines = [], [], [], []
                for text, n, log in zip(texts, counts.tolist(), logs.tolist()):
                    points = len(text.decode("utf-8", "surrogatepass"))
                    letters = points - (len(text) - len(text.translate(None, _NO_LETTERS)))
                    perplexity.append(-log / max(letters, 1) if n else None)
                    chars.append(points - (len(text) - len(text.translate(None, _SPACE))))
                    symbols.append(len(text) - len(text.translate(None, _SYMBOLS)))
                    said = [x for x in text.split(b"\n") if x.strip(_SPACE)]
                    lines.append(len(said) - len(set(said)))
                cols = [part.column(0), part.column(2), *(pa.array(x, pa.int64()) for x in (counts, chars, symbols, lines, covered)), pa.array(perplexity, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BASE.split(", ")])

    return rows.mapInArrow(C.tidy("quality", run), BASE.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _size(n_words: Column | str) -> Column:
    """The binary digits of a number of words."""
    return F.length(F.bin(n_words))


def _distance(middle: Column | float) -> Column:
    return (F.col("log_perplexity") - middle) * F.sqrt("n_words")


def _by_lang(picks: dict, key: Column) -> Column:
    """The value of picks under key; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in picks.items() for x in kv)), key) if picks else F.lit(None).cast("double")


def bands(measured: DataFrame, iqr: float) -> tuple[dict[str, float], dict[tuple[str, int], tuple[float, float]]]:
    """The median of each language, and the limits of the distances from it by language and size,
    from all texts given: the counts by step are exact, and few whatever the number of texts. Texts
    that measure the same in all count once, so that copies don't narrow the band for others."""
    once = measured.where("log_perplexity IS NOT NULL").drop("doc_id").distinct()

    def steps(value: Column, size: Column) -> dict[str, list[np.ndarray]]:
        by: dict[str, list] = {}
        for r in once.groupBy("lang", size.alias("size"), F.floor(value / STEP).alias("step")).agg(F.count("*").alias("n")).collect():
            by.setdefault(r["lang"], []).append((r["step"], r["size"], r["n"]))
        return {lang: [np.array(x) for x in zip(*sorted(rows))] for lang, rows in by.items()}

    def quantile(at: np.ndarray, n: np.ndarray, q: float) -> int:
        total = np.cumsum(n)
        return at[np.searchsorted(total, q * total[-1])]

    middle = {lang: float(quantile(at, n, 0.5) * STEP) for lang, (at, _, n) in steps(F.col("log_perplexity"), F.lit(0)).items()}
    out = {}
    for lang, (at, sizes, n) in steps(_distance(_by_lang(middle, F.col("lang"))), _size("n_words")).items():
        for size in set(sizes.tolist()):
            away, reach = np.abs(sizes - size), 0
            while n[away <= reach].sum() < LEAST_TEXTS and reach < away.max():
                reach += 1
            q1, q3 = (quantile(at[away <= reach], n[away <= reach], q) for q in (0.25, 0.75))
            room = iqr * (q3 - q1)
            out[lang, size] = float((q1 - room) * STEP), float((q3 + 1 + room) * STEP)
    return middle, out


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", iqr: float = BAND_IQR, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    log_perplexity (natural, by letter or digit; null without words), base_failed and kept.

    base_failed: fewer than 10 words, or repeated five-word windows cover over 20 % of the
    words. kept: not base_failed, and the log perplexity lies in the band of its language
    and size, which is that of the texts that aren't base_failed; at a limit a text is kept.
    Null and empty texts have no words and fail; a null language is one of its own, and so is
    the empty one with it. Null ids stay null. Very long texts are measured whole. Repeated rows
    are judged alike. An empty table gives no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "quality")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    grams = scratch.save(count_grams(rows), "grams")
    model, shards = build_model(grams, scratch, shard_grams)
    sent = _send(spark, model, shards)
    scratch.drop_all_but()  # the shards have been sent
    measured = scratch.save(measure(rows, sent), "measured")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    middle, limits = bands(measured.where(~failed), iqr)
    own, place = _distance(_by_lang(middle, F.col("lang"))), F.concat(_size("n_words").cast("string"), F.lit(" "), "lang")
    low, high = (_by_lang({f"{size} {lang}": b[i] for (lang, size), b in limits.items()}, place) for i in (0, 1))
    kept = ~failed & F.coalesce((own >= low) & (own <= high), F.lit(False))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", failed.alias("base_failed"), kept.alias("kept"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.table(spark, sf_dir, "documents")).drop("log_perplexity")
