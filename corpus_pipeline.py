"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage judges rows, not ids: null and repeated doc_ids, null, empty and very long texts and
repeated rows pass like any others unless a stage's docstring says what becomes of them. All columns
of its input pass through every stage but the last, extra ones too. An empty table stays empty.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnwork.llm import langid, line_dedup, near_text, packing, quality
from kilnwork.sources import store
from kilnwork.sources.files import spread

#: A prediction of a lower score counts as no known language.
LEAST_LANGUAGE_SCORE = 0.5


#: What the stage that ran last in this thread has saved on its way.
_last: contextvars.ContextVar[frozenset[str]] = contextvars.ContextVar("last", default=frozenset())


def _stage(judge: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it in this thread saved on its way: that
    one's output is written when the next one begins. Nothing else is removed: not what other
    threads save, nor what other queries save between stages."""

    @functools.wraps(judge)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _forget_last()
        with store.scope() as paths:
            out = judge(spark, docs, sf_dir)
        _last.set(frozenset(paths))
        return out

    return run_stage


def _forget_last() -> None:
    store.forget(_last.get())
    _last.set(frozenset())


def _row(docs: DataFrame, *without: str) -> Column:
    """The columns of ``docs`` as one, out of the way of an operator's own names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without), F.lit(None).alias("_kilnwork")).alias("row")


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter (null and empty ones too), or no language that stands out,
    go. Learned from the labelled ones among ``docs`` that are not held out."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.select(_row(docs), "text"), model)
    known = out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return known.select("row.*").drop("_kilnwork")


@_stage
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each row by the verdict on its own text."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one; n_chars, where there is one, follows the
    text. No row goes; a null text becomes an empty one, a row without doc_id keeps its lines."""
    out = line_dedup.line_dedup(docs.select("doc_id", "text", _row(docs, "doc_id", "text")))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    changed = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(kind) if kind else None}
    return out.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id (one
    without doc_id only where no other is in the group), and one row of repeated rows. Near:
    Jaccard similarity of five-word shingles of 0.8 or more; op8's SimHash postings give candidates,
    and bands those that are over 4 bits apart."""
    return near_text.drop_near_texts(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, placed in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0), 2048)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("lines", dedup_lines),
    ("near duplicates", dedup_documents),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are not SQL; tests hold the pipeline against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows. What a stage has saved on
    its way, and its input, is removed when its output is written. Runs in other threads, and other
    queries, keep their tables."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        out = store.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.release(docs)
        docs = out
    _forget_last()
    return docs
