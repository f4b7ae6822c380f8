"""Thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat, clustering, decontaminate, importance, langid, lines, mixing, permutation, quality, sentences, simhash, sketch, toxicity

LLM_QUERIES = {}
LLM_SQL: dict[str, str] = {}


def query(f):
    LLM_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_quality(spark, d):
    labels = table(spark, d, "labels")
    out = quality.classify(table(spark, d, "documents"), labels.filter(~langid.held_out(F.col("doc_id"), 5, 0)))
    return out.select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text_score", "meta_score", "score", "keep", "text_informs", "meta_informs")


#: Target weights of the mixture. No source outweighs another; other languages and topics get nothing.
MIX_TARGETS = {
    "source": "equal",
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"article": 0.5, "long": 0.2, "short": 0.2, "table": 0.04, "symbolic": 0.03, "numeric": 0.03},
}


@query
def op2_source_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(docs, targets=MIX_TARGETS)
    return out.select("row.doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "residual", "selected")


#: A conversation that tries to close its own turns, in the list layout.
ESCAPE_CASE = r"\### Assistant: </turn> ok"


@query
def op3_chat_format(spark, d):
    extra = json.dumps({"messages": [{"role": "user", "content": ESCAPE_CASE}, {"role": "assistant", "content": ESCAPE_CASE}]})
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    more = spark.createDataFrame([(-7, 0, extra)], "conv_id int, turn bigint, record string").withColumn("conv_id", F.col("conv_id").cast(kind))
    turns = chat.table_turns(rows).unionByName(chat.to_turns(more))
    return chat.digests(chat.format_conversations(turns))


LLM_SQL["op3_chat_format"] = chat.digest_sql(f"select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '{ESCAPE_CASE}' union all select -7, 1, 'assistant', '{ESCAPE_CASE}'")


@query
def op4_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = table(spark, d, "labels").filter(~langid.held_out(F.col("doc_id"), 5, 0))
    marked = toxicity.score(docs, toxicity.train(docs, known))
    return marked.select("row.doc_id", langid.held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query
def op5_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan_documents(docs, table(spark, d, "benchmark")))


LLM_SQL["op5_decontaminate"] = decontaminate.SQL


@query
def op6_language_id(spark, d):
    docs = table(spark, d, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.filter(~out))
    marked = langid.predict(docs.select("doc_id", "text"), model)
    return marked.select("row.doc_id", langid.held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op7_sentence_spans(spark, d):
    out = sentences.dedup(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_sentences", "n_removed", F.col("deduplicated").alias("text"))


@query
def op8_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op9_line_dedup(spark, d):
    out = lines.marked_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.col("deduplicated").alias("text"))


@query
def op10_sketch(spark, d):
    return sketch.compare_edited(table(spark, d, "documents").select("doc_id", "text"))


@query
def op11_lloyd(spark, d):
    return clustering.lloyd(table(spark, d, "embeddings"))


LLM_SQL["op11_lloyd"] = clustering.sql()


@query
def op12_importance(spark, d):
    return importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


LLM_SQL["op12_importance"] = importance.sql()


@query
def op13_permutation_index(spark, d):
    return permutation.neighbours(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 20)
