"""Row identity that survives null and repeated ids: a 128-bit key of id and text. Equal rows have equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(doc_id: str, text: str) -> list[Column]:
    """Columns k1, k2."""
    null = F.col(text).isNull()
    return [F.xxhash64(F.col(doc_id), F.col(text), null).alias("k1"), F.xxhash64(F.col(text), null, F.col(doc_id)).alias("k2")]


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k1, k2 and `row`, a struct of all columns whatever their names."""
    return docs.select(*row_key(doc_id, text), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def keep_rows(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents whose key is in keys, equal rows once. The join leaves rows dealt by key, so the second step moves nothing."""
    return packed(docs, doc_id, text).join(keys, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
