"""MinHash near-duplicates by a chosen-path set similarity join.

Each distinct shingle set has minwise tokens. Independent trees branch on a few tokens
chosen at each node: sets with the same token go to the same child, so that sets alike
meet in some child with high probability (with similarity 0.8 and twelve tokens at the
first level, all but 0.2^12 of the pairs). Small nodes are compared exhaustively on full
sets. A large node is first dealt into blocks that share some pivots, which joins most of
a crowd of copies; then what lies outside its largest component is compared with all its
members, or, where that is much, the node branches again on other tokens. Nodes that are
still large at the last level are compared block by block, all blocks with all.
Texts are dealt out compressed.
Components need no more than a spanning forest of confirmed links, so members of one
component are not compared again and no crowd of copies is expanded into pairs.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Trees, tokens chosen at each node, and minwise tokens that a set has in all.
TREES, WIDTH, TOKENS = 4, 3, 24
#: Size of a node that one task compares exhaustively. A member counts 1 and 1 more for each
#: 256 shingles, so that the sets of a node stay below 50 MB.
NODE, PER_SHINGLES = 20_000, 256
#: Of TOKENS minwise tokens, so many must agree before two sets of a node are compared in full
#: (a pair with similarity 0.8 agrees in fewer with probability 2e-7).
AGREE = 8
#: Pivots, about, of a large node.
PIVOTS = 16
#: Levels of branching before a node is compared block by block.
DEPTH = 3

SETS = "doc_id long, n_shingles long, set_key binary, tokens array<long>"


@functools.lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return tuple(rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, counts = C.word_hashes([t.translate(C.LOWER_BYTES) for t in texts])
    s, at, out = C.chain_hash(h, width), 0, []
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(s[at : at + n - width + 1]))
        elif n:
            out.append(C.mix64(C.chain_hash(h[at : at + n], n) ^ np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens: a row for each non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, TOKENS), np.uint64)
    flat, starts = np.concatenate(full), C.starts_of(np.array([len(s) for s in full]))[:-1]
    out = np.empty((len(full), TOKENS), np.uint64)
    for c, (a, b) in enumerate(zip(*_multipliers())):
        y = flat * a
        y ^= y >> np.uint64(32)
        y *= b
        out[:, c] = np.minimum.reduceat(y, starts)
    return out


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and tokens (both null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, 1, 1 << 20, 64):  # so few that their shingles stay in the processor's cache
                sets = shingle_sets(C.as_bytes(part.column(1)), width)
                tokens = iter(C.signed(_signatures(sets)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(tokens) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "tokens"],
                )

    return docs.mapInArrow(C.tidy("neardup", run), SETS)


class _Forest:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        """Members of the components of others become i's."""
        self.of[np.isin(self.of, np.unique(self.of[others]))] = self.of[i]


def links_within(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join all members of a node which links connect. Each member is
    compared with all later ones outside its component: by minwise tokens, then on full sets."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = C.starts_of(sizes)
    mark, forest, out = np.zeros(number.max() + 1, bool), _Forest(n), []
    tokens = _signatures(sets)
    for i in range(n - 1):
        later = np.flatnonzero(forest.of[i + 1 :] != forest.of[i]) + i + 1
        later = later[(tokens[later] == tokens[i]).sum(axis=1) >= AGREE]
        later = later[(100 * np.minimum(sizes[i], sizes[later])) >= percent * np.maximum(sizes[i], sizes[later])]
        if not len(later):
            continue
        own = number[starts[i] : starts[i + 1]]
        mark[own] = True
        if 3 * len(later) > n:
            both = np.add.reduceat(mark[number].view(np.int8), starts[:-1], dtype=np.int64)[later]
        else:
            both = np.array([np.count_nonzero(mark[number[starts[j] : starts[j + 1]]]) for j in later.tolist()])
        mark[own] = False
        linked = later[100 * both >= percent * (sizes[i] + sizes[later] - both)]
        if len(linked):
            out += [(ids[i], ids[j]) for j in linked.tolist()]
            forest.join(i, linked)
    return out


def _node_links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, id, compressed text), sorted by node, to links (a < b)."""
    large, node, held = zstandard.ZstdDecompressor(), None, {}

    def close() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        packed, sets = list(held.values()), []
        for at in range(0, len(packed), 64):
            sets += shingle_sets([large.decompress(z) for z in packed[at : at + 64]], width)
        found = links_within(list(held), sets, percent)
        a, b = ([f(x) for x in found] for f in (min, max))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if found else None

    for batch in batches:
        for k, d, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if k != node:
                out = close()
                if out is not None:
                    yield out
                node, held = k, {}
            held[d] = z.as_py()
    out = close()
    if out is not None:
        yield out


def connected_components(edges: DataFrame, scratch: C.Scratch, name: str = "cc") -> DataFrame:
    """v and its component's smallest vertex, for all vertices of edges (a, b): alternating
    large and small stars, each round written to the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        both = near.join(least, "u")
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else both.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a <> b").distinct()

    now, state, k = scratch.save(edges.where("a <> b").distinct(), f"{name}0"), None, 0
    while True:
        k += 1
        now = scratch.save(star(star(now, True), False), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == state or not new[0]:
            break
        state = new
    return now.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("component"))


def _nodes(members: DataFrame) -> DataFrame:
    """node, size for the nodes that hold two components or more; of nodes with the same members, one."""
    same = [F.sum("weight").alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")]
    sizes = members.groupBy("node").agg(*same, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return sizes.groupBy("size", "least", "x", "y").agg(F.min("node").alias("node")).select("node", "size")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id (smallest id with the same set) and
    component_id (smallest id reachable by links of at least `percent` similarity).

    Words: runs of anything but ASCII blanks, A-Z in lower case. A text of fewer than
    `width` words is one shingle; an empty or null text has none and is linked with
    nothing, and neither is a row with a null id (its class and component are null).
    Repeated rows get the same result each; ids must tell different texts apart (see
    drop_duplicates). Of equally small ids there is none, so ties cannot arise. Very long texts
    are compared whole. An empty table gives no rows. Extra columns are not read.
    """
    scratch = C.Scratch(docs.sparkSession, "neardup")
    rows = docs.select(C.whole_ids(docs, id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = scratch.save(set_table(rows, width), "sets")
    filled = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.save(filled.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    classed = filled.join(classes, "set_key")
    weight = (1 + F.col("n_shingles") / PER_SHINGLES).cast("int").alias("weight")
    reps = scratch.save(classed.where("doc_id = class_id").select(F.col("doc_id").alias("id"), weight, "tokens").dropDuplicates(["id"]), "reps")
    edges: list[DataFrame] = []

    def texts_of(members: DataFrame, sift: bool) -> DataFrame:
        """id and z, the compressed text; only of the ids that members may hold, if they are to be sifted."""
        sieve = C.sieve_of(members.select("id")) if sift else None

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            small = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                if sieve is not None:
                    batch = batch.filter(pa.array(C.sifted(sieve.value, batch.column(2))))
                for part in C.slices(batch, 1):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small.compress(t) for t in C.as_bytes(part.column(1))], pa.binary())], names=["id", "z"])

        return rows.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(C.tidy("neardup", pack), "id long, z binary")

    def compare(members: DataFrame, name: str, sift: bool = True) -> None:
        """members: node, id. Adds the confirmed links of each node. At the root most texts are in some
        node; below it, few are, and the others need no shuffle."""
        members = scratch.save(members, f"{name}_members")
        dealt = members.hint("shuffle_hash").join(texts_of(members, sift), "id").repartition("node").sortWithinPartitions("node").select("node", "id", "z")
        edges.append(scratch.save(dealt.mapInArrow(C.tidy("neardup", lambda b: _node_links(b, width, percent)), "a long, b long"), name))

    def sub(*cols) -> F.Column:
        return F.xxhash64("node", *cols).alias("node")

    first = F.slice("tokens", 1, TREES * WIDTH)
    members = reps.select(F.posexplode(first).alias("at", "token"), "id", "weight").select(F.xxhash64("at", "token").alias("node"), "id", "weight", F.col("id").alias("component"))
    half = max(1, node // 2)
    level = 0
    while True:
        nodes = scratch.save(_nodes(members), f"nodes{level}")
        members = scratch.save(members.join(nodes.hint("shuffle_hash"), "node").select("node", "id", "weight", "size"), f"members{level}")
        big = members.where(F.col("size") > node)
        if not nodes.where(F.col("size") > node).limit(1).count():
            compare(members.select("node", "id"), f"links{level}", sift=level > 0)
            break
        # A large node's blocks share the members whose hash leaves no remainder: about PIVOTS of them.
        blocks = F.ceil(F.col("size") / half).cast("int")
        pivot = F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("size") / PIVOTS)) == 0
        one = F.array(F.pmod(F.xxhash64("node", "id"), blocks).cast("int"))
        dealt = big.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(one))).select(sub("block"), "id")
        compare(members.where(F.col("size") <= node).select("node", "id").unionByName(dealt), f"links{level}", sift=level > 0)
        found = connected_components(functools.reduce(DataFrame.unionByName, edges), scratch, f"cc{level}_")
        big = scratch.save(big.join(found.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), f"big{level}")
        each = big.groupBy("node", "component").agg(F.sum("weight").alias("n"))
        most = each.groupBy("node").agg(F.max(F.struct("n", "component")).alias("most"))
        most = scratch.save(most.select("node", F.col("most.component").alias("largest"), F.col("most.n").alias("n")), f"most{level}")
        open_ = big.join(most, "node").where("n < size").withColumn("outside", F.col("component") != F.col("largest"))
        outside = F.col("size") - F.col("n")
        # Few outside the largest component: they meet every block of the others.
        blocks = F.ceil(F.col("n") / half).cast("int")
        one = F.array(F.pmod(F.xxhash64("node", "id"), blocks).cast("int"))
        few = open_.where(outside <= half).withColumn("block", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), blocks - 1)).otherwise(one))).select(sub("block", F.lit("few")), "id")
        few = scratch.save(few, f"fewer{level}")
        if few.limit(1).count():
            compare(few, f"few{level}")
        many = open_.where(outside > half)
        level += 1
        if level >= depth:
            # The exact way for the rest: every pair of blocks is a node.
            blocks = F.ceil(F.col("size") / half).cast("int")
            own = F.pmod(F.xxhash64("node", "id"), blocks).cast("int")
            pairs = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            compare(pairs.select(sub(F.least("own", "other"), F.greatest("own", "other"), F.lit("all")), "id"), "rest")
            break
        if not many.limit(1).count():
            break
        # The node branches on WIDTH of the tokens, chosen by its own hash.
        with_tokens = many.select("node", "id", "weight", "component").join(reps.select("id", "tokens"), "id")
        turn = F.sequence(F.lit(0), F.lit(WIDTH - 1))
        at = F.transform(turn, lambda k: F.pmod(F.pmod(F.xxhash64("node"), F.lit(TOKENS)) + k * 7, F.lit(TOKENS)).cast("int"))
        members = with_tokens.select("node", "id", "weight", "component", F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), F.get("tokens", i).alias("token")))).alias("t")).select(sub("t.at", "t.token"), "id", "weight", "component")
    # Members of one class are linked by their equal sets; classes by the components.
    found = connected_components(functools.reduce(DataFrame.unionByName, edges), scratch, "cc_")
    own = classes.withColumnRenamed("set_key", "_own")
    of_class = C.left_join(sets, own, "set_key", "_own", "doc_id").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    of_class = scratch.save(of_class, "of_class")
    scratch.drop_all_but("of_class", *(n for n in scratch.names if re.fullmatch(r"cc_\d+", n)))
    # A row with a null id has no class: the number of its shingles spreads those.
    return C.left_join(of_class, found, "class_id", "v", "n_shingles").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all its columns, but of each group of near-duplicates only the row with the smallest id.

    Where ids are no whole numbers, or different texts share one, rows are numbered by id and
    digest of the text, and the number is what is compared; of rows equal in both, one stays.
    Rows with a null id all stay. Options are those of near_duplicates.
    """
    scratch = C.Scratch(docs.sparkSession, "deduped")
    rows, keys = C.key_rows(docs, id_col, text_col)
    found = near_duplicates(rows, **options)
    own, row_id = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{id_col}`")
    gone = scratch.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_key")).distinct(), "gone")
    if keys is None:
        # Most rows are in no group: only those whose id the sieve of the dropped ones may hold are joined.
        may = C.may_hold(C.sieve_of(gone), row_id.cast("long"))
        mark = C.fresh(docs.columns, "_may")
        marked = docs.withColumn(mark, F.coalesce(may, F.lit(False)))
        left = marked.where(F.col(mark)).join(gone.hint("shuffle_hash"), row_id.cast("long") == F.col("_key"), "left_anti")
        return marked.where(~F.col(mark)).select(*own).unionByName(left.select(*own))
    gone = scratch.save(gone.join(keys, F.col("_key") == F.col("doc_id")).select(F.col("_id").alias("_i"), F.col("_digest").alias("_d")), "gone_rows")
    mark = C.fresh(docs.columns, "_digest")
    named = docs.where(row_id.isNotNull()).withColumn(mark, F.sha2(F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8"), 256))
    kept = named.join(gone, (row_id == F.col("_i")) & (F.col(mark) == F.col("_d")), "left_anti").dropDuplicates([id_col, mark])
    return kept.select(*own).unionByName(docs.where(row_id.isNull()))


def op6_chosen_path_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"), width=4)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
