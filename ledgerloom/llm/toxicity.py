"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their first bytes is trained with numpy from
confirmed toxic texts (P) and texts of unknown kind (U), drawn from the documents without a look
at their labels. With the class prior p, the risk is
p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]): what U holds of toxic texts is taken off
the negative part, and where that part falls below zero the step goes back instead.
The prior is estimated from P and U alone: a classifier of the one against the other is fitted
on half of the sample, and on the other half no threshold may pass less of U than the prior's
share of what it passes of P. Labels other than the confirmed ones are never read.
The sample is bounded by parameters; scores cover every word of every text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: The sample: at most so many confirmed toxic and unlabelled texts, by the least hash of their ids.
POSITIVES, UNLABELLED = 4_000, 12_000
#: What becomes a feature: held by so many texts of the sample, and its shares of P and of U so
#: many standard deviations of their difference apart, to either side.
LEAST_TEXTS, LEAST_Z = 4, 5.0
#: Words also count by their first bytes, so that inflected and joined forms share evidence.
PREFIXES = (4, 5)
#: Features go by the low 32 bits of their hash, which halves what the driver gathers.
LOW = 0xFFFFFFFF
EPOCHS, BATCH, RATE, DECAY = 30, 512, 0.015, 1e-4
#: For the prior: thresholds that pass this share of P at least.
LEAST_SHARE = 0.2

KIND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def _features(text: bytes) -> set[bytes]:
    words = set(text.translate(C.NORMAL_BYTES).split())
    return words.union(*({w[:n] + b"*" for w in words if len(w) >= n} for n in PREFIXES))


def _fold(id_col: Column | str, folds: int, held_out: int) -> Column:
    return F.pmod(C.crc32_of_id(id_col), F.lit(folds)) == held_out


def _sample(docs: DataFrame, confirmed: DataFrame, positives: int, unlabelled: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word hashes of the texts in P and in U. docs (id, text) and confirmed (id) are those to learn from.

    Each sample is the texts with the least hashes of their ids: a threshold on the hash that leaves
    few more than are wanted is set from the count, so that no task sorts or sends more.
    """

    def least(ids: DataFrame, n: int) -> DataFrame:
        total = ids.count()
        some = ids.withColumn("h", F.xxhash64("id"))
        if total > 2 * n:
            some = some.where(F.col("h") < -(2**63) + int(2**64 * (n + 6 * math.sqrt(n)) / total))
        return some.orderBy("h", "id").limit(n).select("id")

    drawn = least(confirmed.distinct(), positives).withColumn("part", F.lit(1)).unionByName(least(docs.select("id").distinct(), unlabelled).withColumn("part", F.lit(0)))
    texts = docs.join(F.broadcast(drawn), "id").select("text", "part")  # 16,000 ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = C.WordHash()
        for batch in batches:
            for part in C.slices(batch, 0):
                got = [np.unique(np.fromiter((known[w] & LOW for w in _features(t)), np.uint32)).tobytes() for t in C.as_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), part.column(1)], names=["words", "part"])

    found: tuple[list, list] = ([], [])
    for r in texts.mapInArrow(C.tidy("toxicity", run), "words binary, part int").collect():
        found[r["part"]].append(np.frombuffer(r["words"], np.uint32))
    for part in found:
        part.sort(key=lambda a: (len(a), a.tobytes()))  # the same training, whatever order tasks end in
    return found[1], found[0]


class _Texts:
    """Feature numbers of texts, one after another."""

    def __init__(self, texts: list[np.ndarray], vocabulary: np.ndarray):
        own = [np.searchsorted(vocabulary, t[np.isin(t, vocabulary, assume_unique=True)]) for t in texts]
        self.rows = own

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [self.rows[i] for i in at.tolist()]
        return np.concatenate(own) if own else np.empty(0, np.int64), np.repeat(np.arange(len(own)), [len(x) for x in own])


def vocabulary_of(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z) -> np.ndarray:
    """The features (sorted hashes) whose shares of P and of U differ for certain; in a sample too
    small for certainty, those that differ most."""
    words, n = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
    in_p = np.bincount(np.searchsorted(words, np.concatenate(positive)), minlength=len(words))
    share = n / (len(positive) + len(unlabelled))
    spread = np.sqrt(np.maximum(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)), 1e-12))
    apart = in_p / len(positive) - (n - in_p) / len(unlabelled)
    certain = np.where(n >= least_texts, np.abs(apart) / spread, 0.0)
    return words[certain >= min(least_z, max(certain.max(initial=0.0) / 2, 1.0))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(p: _Texts, u: _Texts, d: int, prior: float | None, *, epochs: int, batch: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights of d features and, last, the bias, by Adam on the logistic loss: of the non-negative
    risk, or where there is no prior, of P against U with equal weight."""
    n_p, n_u = len(p.rows), len(u.rows)
    batch = max(32, min(batch, n_u // 10))  # ten steps an epoch at least
    w, m, v = (np.zeros(d + 1) for _ in range(3))
    if prior is not None:
        w[d] = math.log(prior / (1 - prior))
    rng, step, turns = np.random.default_rng(seed), 0, max(1, -(-n_u // batch))
    for _ in range(epochs):
        order_p, order_u = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(turns):
            a = k * n_p // turns
            at_p, at_u = order_p[a : max((k + 1) * n_p // turns, a + 1)], order_u[k * batch : (k + 1) * batch]
            if not len(at_p) or not len(at_u):
                continue
            (fp, rp), (fu, ru) = p.take(at_p), u.take(at_u)
            zp = np.bincount(rp, w[fp], len(at_p)) + w[d]
            zu = np.bincount(ru, w[fu], len(at_u)) + w[d]
            q = 0.5 if prior is None else prior
            gp_pos, gu = -q * _sigmoid(-zp) / len(at_p), _sigmoid(zu) / len(at_u)
            if prior is None:
                gp, gu = gp_pos, 0.5 * gu
            else:
                gp_neg = -q * _sigmoid(zp) / len(at_p)
                if np.logaddexp(0, zu).mean() < q * np.logaddexp(0, zp).mean():  # back from fitting U below what P allows
                    gp, gu = -gp_neg, -gu
                else:
                    gp = gp_pos + gp_neg
            g = np.bincount(fp, gp[rp], d + 1).astype(float) + np.bincount(fu, gu[ru], d + 1)
            g[d] = gp.sum() + gu.sum()
            g[:d] += decay * w[:d]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def scores_of(texts: _Texts, w: np.ndarray) -> np.ndarray:
    f, r = texts.take(np.arange(len(texts.rows)))
    return np.bincount(r, w[f], len(texts.rows)) + w[-1]


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], *, seed: int = 7, **how) -> float:
    """The share of U that is like P: at no threshold may U pass less than that share of what P passes."""
    found = []
    for own in (0, 1):
        p, u = positive[own::2], unlabelled[own::2]
        other_p, other_u = positive[1 - own :: 2], unlabelled[1 - own :: 2]
        if not (p and u and other_p and other_u):
            continue
        vocabulary = vocabulary_of(p, u)
        w = fit(_Texts(p, vocabulary), _Texts(u, vocabulary), len(vocabulary), None, **(dict(epochs=EPOCHS, batch=BATCH, rate=RATE, decay=DECAY) | how), seed=seed)
        zp, zu = (np.sort(scores_of(_Texts(x, vocabulary), w)) for x in (other_p, other_u))
        at = np.unique(zp)
        share_p, share_u = (1 - np.searchsorted(z, at) / len(z) for z in (zp, zu))
        some = share_p >= LEAST_SHARE
        if some.any():
            found.append(float(((share_u[some] + 1 / len(zu)) / share_p[some]).min()))
    return float(np.clip(np.mean(found), 1e-4, 0.95)) if found else 0.5


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None, *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes (sorted), their weights, and the bias. Without a prior, it is estimated.

    The non-negative risk shrinks the scores of texts with little evidence, so the bias is set
    afterwards, where the same risk of wrong predictions is least, p P[f < 0 | P] + U[f >= 0] -
    p P[f >= 0 | P]; but no text without evidence of half the prior's log odds is predicted."""
    if prior is None:
        prior = estimate_prior(positive, unlabelled, seed=seed, epochs=epochs, batch=batch, rate=rate, decay=decay)
    vocabulary = vocabulary_of(positive, unlabelled)
    p, u = _Texts(positive, vocabulary), _Texts(unlabelled, vocabulary)
    w = fit(p, u, len(vocabulary), prior, epochs=epochs, batch=batch, rate=rate, decay=decay, seed=seed)
    zp, zu = np.sort(scores_of(p, w)), np.sort(scores_of(u, w))
    at = np.unique(zp)
    share_p, share_u = (1 - np.searchsorted(z, at) / len(z) for z in (zp, zu))
    cut = float(at[(2 * prior * share_p - share_u).argmax()])
    under = [float(z[z < cut].max()) for z in (zp, zu) if z[0] < cut]
    cut = (cut + max(under)) / 2 if under else cut - 1e-9  # half way to the next score below
    least = 0.5 * math.log((1 - prior) / prior) if prior < 0.4 else 0.2
    return vocabulary, w[:-1], float(w[-1] - max(cut, w[-1] + least))


class _Weights(dict):
    """A word's weight, by its hash; words that aren't features weigh nothing."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        self.of, self.bias = dict(zip(vocabulary.tolist(), weights.tolist())), bias

    def __missing__(self, word: bytes) -> float:
        value = self.of.get(xxhash.xxh3_64_intdigest(word) & LOW, 0.0)
        if len(self) < C.WordHash.LIMIT:
            self[word] = value
        return value


def mark_toxicity(docs: DataFrame, labels: DataFrame, into: str, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5, held_out: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> DataFrame:
    """All columns of docs, whatever their names, and the struct `into` of score and predicted (1 if
    score >= 0.5).

    P: documents whose label is 1 and whose crc32(id as text) modulo `folds` is not `held_out`. U:
    documents of these folds, whatever their labels. Only words are inputs. Without a given
    prior it is estimated. Null and empty texts are scored by the bias; very long ones whole.
    Without a confirmed toxic text to learn from, all scores are 0. Labels that are null, 0
    or of ids that docs lacks are not used; of repeated labels of an id one that is 1 counts.
    Ids are compared as text; rows with a null id are scored but not learnt from. Repeated
    rows of docs are scored alike, and equal scores are equal predictions. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    key = lambda c: F.col(c).cast("string")
    confirmed = labels.where(F.col(label_col).cast("int") == 1).where(F.col(label_id_col).isNotNull()).where(~_fold(label_id_col, folds, held_out)).select(key(label_id_col).alias("id"))
    rows = docs.where(F.col(id_col).isNotNull()).where(~_fold(id_col, folds, held_out)).select(key(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    p, u = _sample(rows, confirmed, positives, unlabelled)
    vocabulary, weights, bias = train(p, u, prior) if p and u else (np.empty(0, np.uint32), np.empty(0), -math.inf)
    p.clear(), u.clear()
    C.give_back()
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((vocabulary, weights, bias))

    def score(texts: list[bytes]) -> list[pa.Array]:
        known = C.loaded(name, sent, lambda x: _Weights(*x))
        z = [known.bias + math.fsum(map(known.__getitem__, _features(t))) for t in texts]
        got = [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in z]
        return [pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())]

    return C.with_struct(docs, "toxicity", text_col, into, KIND, score)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Per row of docs: doc_id (as it is), held_out, score and predicted; see mark_toxicity. Extra
    columns are not read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = mark_toxicity(own, labels, "toxicity", folds=folds, held_out=held_out, **options)
    return marked.select("doc_id", _fold("doc_id", folds, held_out).alias("held_out"), "toxicity.*")


def op7_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
