"""From raw documents to packed batches: five stages, each of which works on all that the one before kept.

quality     documents that the quality rules reject go
lines       later copies of repeated line runs are cut out; documents left without a word go
near_copies of every group of near copies one document stays
mix         documents are repeated or dropped so that sources reach their target shares
pack        the pieces of every document are put into length buckets and batches

All but the last return the columns of documents; the last returns one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import _common, jaccard, linedup, mixing, packing, rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_documents(docs, _common.documents(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.cleaned_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Not expressible in SQL (tilted rates, near copies by connected components, dynamic programming); tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.spool(docs)
    return docs
