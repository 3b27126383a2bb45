"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and all but the last return the columns of ``documents``, whatever other
columns those are.  Null ids, sources and texts, repeated rows and empty tables are
fine in every stage; what each makes of them is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.llm import jaccard, mixing, packing, secrets, toxicity
from tapewright.llm.common import fresh, scratch, written
from tapewright.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go.

    Equal texts go or stay together; a null or empty text scores as one without any
    feature and stays; rows without an id are scored but teach nothing.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more.

    The smallest id stays, and one of repeated rows; a row without an id only where no
    member of its group has one; null, empty and blank texts are in no group and stay.
    """
    return jaccard.deduplicate(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; no document goes.

    Null and empty texts stay as they are, repeated rows are redacted alike.
    """
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, in the order of the output shards.

    A null source is one of its own; documents without words, null texts included,
    come along with their block; rows of equal id and text are drawn alike.
    """
    return mixing.repeat_drawn(docs, weights=(1, 2, 3), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences.

    A null or empty text is its end mark alone; repeated rows are packed as often as they come.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL form: a trained classifier and a packing heuristic decide.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the other stages wrote on the way is deleted as they end.

    The last stage's own tables and its input stay in the shared folder, as its result is lazy.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for _, stage in STAGES[:-2]:
            with scratch(spark):
                made = written(stage(spark, docs, sf_dir), outer=True)
            docs = made
        docs = written(STAGES[-2][1](spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
