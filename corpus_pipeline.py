"""A corpus from documents: language ID, line dedup, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm import langid, linededup, mixing, simhash
from cubespark.llm.common import fresh, removed, written
from cubespark.llm.queries import digests
from cubespark.plans.scratch import folder

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5
#: Documents of which the told language knows a smaller share of the words are in no language of the model.
LEAST_KNOWN = 0.25


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that is told with a posterior of LEAST_SCORE or more and knows LEAST_KNOWN of the words.

    The model is fitted on documents that aren't held out and have an id, a language and a text; without any, all go.
    Null texts and texts without letters go. Equal texts get equal decisions, so repeated rows stay or go together; of
    languages as likely the first by code point is told. An empty table gives an empty table. Columns keep their
    values, whatever their names.
    """
    names = tuple(fresh(docs, "lang_pred", "score", "known"))
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    lang, score, known = map(F.col, names)
    sure = (lang != "und") & (score >= LEAST_SCORE) & (known >= LEAST_KNOWN)
    return langid.identify(docs, model, names=names).filter(sure).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those of which no line stays go.

    Occurrences are ordered by (doc_id, hash of the text, position), null ids last; rows equal in id and text are one
    document. Null and empty texts and texts under three lines stay whole. ``n_chars`` follows the text where there
    is such a column; others keep their values, whatever their names. An empty table gives an empty table.
    """
    n_lines, n_removed, kept_text = names = tuple(fresh(docs, "n_lines", "n_removed", "kept_text"))
    found = linededup.dedup_lines(docs, names=names)
    left = found.filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    changed = {"text": F.when(F.col(n_removed) > 0, F.col(kept_text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(n_removed) > 0, F.length(kept_text).cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns(changed).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of the smallest id (null last), then the smallest hash of the row.

    Null, empty and blank texts share the fingerprint zero, so one of them stays (with whatever is linked to it).
    Repeated rows are one group. An empty table gives an empty table. Columns keep their values, whatever their names.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, longer ones likelier within their source.

    A null source is a source of its own. Texts without words have size 0 and no target to meet. Rows equal in id and
    size are taken together. An empty table gives an empty table. Columns keep their values, whatever their names.
    """
    return mixing.repeat_rows(docs, doc_weight=mixing.length_weight(F.col("text")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each row of the mix: a null text counts as empty, equal texts get equal digests, repeated
    rows stay repeated, an empty table gives an empty table; other columns aren't looked at."""
    return digests(docs.select("doc_id", "text"))


STAGES = [("language_id", identified), ("line_dedup", without_repeated_lines), ("simhash_dedup", without_near_copies), ("source_mix", mixed), ("byte_bpe", encoded)]

#: Hashes by XXH64 and models aren't expressible in SQL; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    Each stage is written as Parquet in a folder of the run's own under the shared one; its input goes once it is
    there, and what the last stage reads when the session ends.
    """
    top = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    removed(spark, top, at_exit=True)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{top}/{name}")
        if before:
            removed(spark, before)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
