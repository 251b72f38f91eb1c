"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import chat, codes, ctw, decontaminate, htmltext, idfiles, langid, lexical, mixing, pivots, quality, simhash, urlfilter
from tapeworks.llm.common import id_remainder, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op1_pivots"] = pivots.SQL


@query
def op2_urlfilter(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.screen_pages(spark, sf)


ORACLES["op2_urlfilter"] = urlfilter.SQL


@query
def op3_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs, rest = read(spark, sf, "documents"), id_remainder("doc_id", 3)
    model = langid.fit(docs, rest != 1)
    return langid.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(rest == 1, F.lit(False))})


@query
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = quality.fit(docs, read(spark, sf, "labels"), id_remainder("_id", 4) != 2)
    return quality.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))})


@query
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"))


ORACLES["op4_mixing"] = mixing.SQL


@query
def op5_html(spark: SparkSession, sf: str) -> DataFrame:
    return htmltext.extract(read(spark, sf, "pages"))


@query
def op6_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.digest_of_table(spark, sf)


ORACLES["op6_chat"] = chat.SQL


@query
def op7_ctw(spark: SparkSession, sf: str) -> DataFrame:
    docs, rest = read(spark, sf, "documents"), id_remainder("doc_id", 5)
    return ctw.score(docs, rest != 1, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(rest == 1, F.lit(False))})


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query
def op11_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


ORACLES["op11_lexical"] = lexical.SQL


@query
def op12_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.compress(read(spark, sf, "embeddings"))


ORACLES["op12_codes"] = codes.sql()


@query
def op13_idfiles(spark: SparkSession, sf: str) -> DataFrame:
    return idfiles.digest(spark, idfiles.write(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
