"""Queries for the kNN-based resamplers (F14-F17) on labelled documents:
target toxic, continuous features quality and n_chars (SMOTENC adds lang)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import neighbors as NB
from tabflow.plans.registry import register, table


def _docs(spark, sf):
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(doc, "doc_id").select("doc_id", "toxic", F.col("quality").cast("double").alias("quality"),
                                          F.col("n_chars").cast("double").alias("n_chars"), "lang")


@register("smote")
def smote(spark, sf):
    return NB.smote(_docs(spark, sf), "toxic", ["quality", "n_chars"], ["doc_id"])


@register("smotenc")
def smotenc(spark, sf):
    return NB.smote(_docs(spark, sf), "toxic", ["quality", "n_chars"], ["doc_id"], cat_cols=["lang"])


@register("adasyn")
def adasyn(spark, sf):
    return NB.adasyn(_docs(spark, sf), "toxic", ["quality", "n_chars"], ["doc_id"])


@register("smote_enn")
def smote_enn(spark, sf):
    return NB.smote_enn(_docs(spark, sf), "toxic", ["quality", "n_chars"], ["doc_id"])
