"""The corpus pipeline: five stages over documents, each of all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of docs, whatever
their names; the last one gives the pieces of the packed sequences. Texts of any length are
judged whole, a null text as the empty one, repeated rows alike. No stage fails on an empty
table: it gives none, and without labels or benchmark items it removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm import decontaminate, neardup, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic. Empty and null texts hold no
    evidence and stay, and so do rows with a null id that hold none. A score of exactly 0.5 is toxic."""
    mark = C.fresh(docs.columns, "_toxicity")
    return toxicity.mark_toxicity(docs, C.table(spark, sf_dir, "labels"), mark).where(F.col(mark)["predicted"] == 0).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, that with
    the smallest id; of different texts under one id, that with the smallest digest; of rows equal
    in both, one. Empty and null texts are linked with nothing; one stays for each id. Rows with a
    null id are neither linked nor dropped."""
    return neardup.drop_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which ten consecutive words of a benchmark item occur, or the whole
    of a shorter item. Texts without words stay; ids, also null ones, play no part."""
    mark = C.fresh(docs.columns, "_hits")
    return decontaminate.mark_hits(docs, C.table(spark, sf_dir, "benchmark"), mark).where(F.col(mark)["n_hit"] == 0).select(*_own(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each secret in the text replaced by [SECRET], of overlapping ones the first; n_chars, if
    docs has it, follows. All rows stay; null texts stay null; ids play no part but for finding
    candidates."""
    mark = C.fresh(docs.columns, "_spans")
    found = secrets.mark_secrets(docs, mark)
    out = found.withColumn("text", F.when(F.size(mark) > 0, secrets.redacted(F.col("text"), F.col(mark))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(mark) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*_own(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, best-fit packed into sequences of 2048 tokens. Null and empty
    texts are the end token alone; repeated rows give repeated pieces; a document over 2048 tokens
    is cut; pieces of equal length go in the order in which they are read."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Training, token ids and best-fit packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    scratch = C.Scratch(spark, "corpus")
    docs, last = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
