"""A corpus pipeline over documents: each stage works on all that the one before it kept.

quality      documents that the classifier, learned from all labels, scores below its threshold go
language     documents of no language, or of one that the codewords can't tell, go
near_dedup   of each group of near copies (fingerprints as operator 9 links them, or 0.8 of all five-word shingles) the
             document with the smallest id stays
decontaminate  documents that overlap a benchmark item go
mix          how many words of each document the mix of sources takes

All but the last return the columns of their input. NULL texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored
from tapeworks.llm import decontaminate, langid, mixing, quality, simhash
from tapeworks.llm.common import read


def _kept(docs: DataFrame) -> dict:
    return {f"_{i}": docs[f"`{c}`"] for i, c in enumerate(docs.columns)}


def _text(docs: DataFrame) -> str:
    return f"_{docs.columns.index('text')}"


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return _back(quality.score(docs, model, _kept(docs), kept_text=_text(docs)).where("predicted = 1"), docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    return _back(langid.predict(docs, model, _kept(docs), kept_text=_text(docs)).where("lang_pred <> 'und' and not ambiguous"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, budget=simhash.BUDGET)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_dedup", near_dedup), ("decontaminate", no_benchmark), ("mix", mix)]
ORACLE_SQL = None  # SQL can't express the classifiers and fingerprints; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
