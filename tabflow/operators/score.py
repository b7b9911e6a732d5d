"""Scoring with fitted pipelines (J1-J4): batch frames, records and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.operators.clean import scoring_schema_problems
from tabflow.operators.pipeline import PreprocessorModel


def class_labels(model: PipelineModel) -> list[str] | None:
    """Labels in index order from the pipeline's label indexer (None for regression)."""
    for st in model.stages:
        if hasattr(st, "labels") and st.getOutputCol() == "label":
            return list(st.labels)
    return None


def with_probabilities(pred: DataFrame, labels: list[str]) -> DataFrame:
    """``prob_{class}`` columns from the probability vector."""
    a = vector_to_array("probability")
    return pred.select("*", *[a[i].alias(f"prob_{lab}") for i, lab in enumerate(labels)])


def threshold_predict(df: DataFrame, prob_pos: str, threshold: float | None, pos, neg,
                      default_col: str = "prediction_label") -> DataFrame:
    """Binary decision with the stored optimal threshold; without one the
    model's own prediction is kept."""
    if threshold is None:
        return df.withColumn("prediction", F.col(default_col))
    return df.withColumn("prediction", F.when(F.col(prob_pos) >= F.lit(threshold), F.lit(pos)).otherwise(F.lit(neg)))


def batch_predict(df: DataFrame, pre: PreprocessorModel | None, model: PipelineModel, keep: list[str],
                  threshold: float | None = None, check_input: bool = True) -> DataFrame:
    """Validate → preprocess → predict → ``prediction`` (+ ``prob_*``).

    The raw input is checked against the raw training schema (columns present,
    numeric columns numeric); any problem raises before work starts."""
    if check_input and pre is not None:
        from pyspark.sql import types as T
        raw = T.StructType.fromJson(__import__("json").loads(pre.state["raw_schema"]))
        target = pre.config.target
        # the target and the training-only sample weight are not scoring inputs
        raw = T.StructType([f for f in raw.fields if f.name not in (target, "_sample_weight")])
        problems = scoring_schema_problems(df.schema, raw)
        if problems:
            raise ValueError(f"scoring input does not fit the training schema: {problems}")
    x = pre.transform(df) if pre is not None else df
    p = model.transform(x)
    labels = class_labels(model)
    if labels is None:
        return p.select(*keep, "prediction")
    p = with_probabilities(p, labels)
    lab_map = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(float(i)), F.lit(lab))])
    p = p.withColumn("prediction_label", lab_map[F.col("prediction")])
    if threshold is not None and len(labels) == 2:
        p = threshold_predict(p, f"prob_{labels[1]}", threshold, labels[1], labels[0])
    else:
        p = p.withColumn("prediction", F.col("prediction_label"))
    return p.select(*keep, "prediction", *[f"prob_{lab}" for lab in labels])


def predict_json(records: DataFrame, json_col: str, schema, pre: PreprocessorModel | None, model: PipelineModel,
                 keep: list[str], threshold: float | None = None) -> DataFrame:
    """A column of JSON records, read and scored on the executors as a batch is."""
    df = records.select(F.from_json(json_col, schema).alias("r")).select("r.*")
    return batch_predict(df, pre, model, keep=keep, threshold=threshold)


def predict_records(spark: SparkSession, records: list[dict], schema, pre: PreprocessorModel | None,
                    model: PipelineModel, keep: list[str], threshold: float | None = None) -> DataFrame:
    """A list of dicts scored through the same path as a batch; ``keep``
    names the record columns returned with the predictions (e.g. the id)."""
    df = spark.createDataFrame(records, schema=schema)
    return batch_predict(df, pre, model, keep=keep, threshold=threshold)
