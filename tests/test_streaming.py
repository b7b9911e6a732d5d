"""A fitted pipeline scores a stream (parquet files arriving in a folder)."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabflow.operators import models as MD
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig
from tabflow.streaming import score_stream

from conftest import SF001


def test_stream_scoring_matches_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        "event_id", "user_id", "event_type", "value", (F.col("event_type") == "purchase").cast("string").alias("bought"))
    feats = ev.drop("event_type")
    pre = Preprocessor(PreprocessorConfig(target="bought", keep_columns=["event_id"])).fit(feats)
    pm = MD.build_pipeline(LogisticRegression(maxIter=20), pre.feature_columns, "bought", "binary_classification") \
        .fit(pre.transform(feats))
    src = str(tmp_path / "incoming")
    feats.drop("bought").write.parquet(src)
    q = score_stream(spark, src, feats.drop("bought").schema, pre, pm, keep=["event_id"], name="scored_events",
                     checkpoint=str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("select event_id, prediction from scored_events")
    from tabflow.operators.score import batch_predict
    batch = batch_predict(feats.drop("bought"), pre, pm, keep=["event_id"]).select("event_id", "prediction")
    assert streamed.count() == feats.count()
    assert streamed.exceptAll(batch).count() == 0
