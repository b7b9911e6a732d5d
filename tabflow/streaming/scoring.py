"""Score a stream with a fitted preprocessor + model (J1 on ``readStream``).

The reference has no stream operators; only its stateless transforms apply
to streams. A fitted ``PreprocessorModel`` is projections plus stream-static
lookup joins (rare categories, target encodings), and an MLlib
``PipelineModel`` transform is row-wise, so the whole scoring path runs
unchanged on a streaming DataFrame. A query restarted with the same
``checkpoint`` folder resumes where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabflow.operators.pipeline import PreprocessorModel
from tabflow.operators.score import batch_predict
from tabflow.session import scratch_path


def scored_stream(stream: DataFrame, pre: PreprocessorModel | None, model: PipelineModel, keep: list[str],
                  threshold: float | None = None) -> DataFrame:
    """The scoring plan over a streaming frame (no input validation job: a
    stream's schema is fixed by its source definition)."""
    return batch_predict(stream, pre, model, keep=keep, threshold=threshold, check_input=False)


def score_stream(spark: SparkSession, source_dir: str, schema, pre: PreprocessorModel | None, model: PipelineModel,
                 keep: list[str], sink: str = "memory", name: str = "scored", output_path: str | None = None,
                 threshold: float | None = None, max_files_per_trigger: int | None = None,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Start a streaming query reading Parquet files as they arrive in
    ``source_dir`` and appending scored rows to ``sink`` (``memory`` for
    tests, ``parquet`` with ``output_path`` otherwise). A lasting sink needs a
    ``checkpoint`` folder of its own: with a new one all files would be scored again."""
    if checkpoint is None and sink != "memory":
        raise ValueError("name the checkpoint folder that a restarted query resumes from")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = scored_stream(reader.parquet(source_dir), pre, model, keep, threshold)
    w = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}"))
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).option("path", output_path).start()
