"""Score batches as they arrive (Structured Streaming + ``foreachBatch``).

The reference scores one uploaded file per request and then checks the
user's alert rule. The same work as a stream: new files in a folder are
micro-batches; each batch is preprocessed and scored with a fitted linear
model (Column expressions), then written out with its run record and any
triggered alert rows. The sinks are append-only Parquet tables and the
checkpoint lives under the shared ``spark.checkpoint.dir``, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.operators import alerts, history
from vatlens.plans import commands
from vatlens.plans.linear import LinearModel
from vatlens.plans.preprocess import FeatureSpec
from vatlens.session import checkpoint_dir


def scoring_stream(spark: SparkSession, source: str, schema: T.StructType | str,
                   model: LinearModel, spec: FeatureSpec, rules: DataFrame, sink: str,
                   username_col: str = "username", fmt: str = "parquet",
                   query_name: str = "vatlens_scoring", stats: str = "model", model_name: str = "stream"):
    """Start the query; returns the ``StreamingQuery``.

    ``sink/scored``: scored rows with the batch id; ``sink/batches``: per
    (batch, user) statistics and trigger flag; ``sink/alerts``: triggered rows;
    ``sink/runs``: one run record per (batch, user) for the history (S8).
    """
    stream = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        stream = stream.option("header", True)
    src = stream.load(source)
    rules = rules.cache()   # small dimension reused by every micro-batch

    def handle(batch: DataFrame, batch_id: int) -> None:
        # each micro-batch owns the partition batch_id=N of every sink and
        # overwrites it, so a replayed batch (after a failure) is idempotent
        part = f"batch_id={batch_id}"
        scored = commands.predict(spark, batch, model, spec, output="processed", stats=stats)
        scored.write.mode("overwrite").parquet(f"{sink}/scored/{part}")
        done = spark.read.parquet(f"{sink}/scored/{part}").withColumn(
            "batch_id", F.lit(batch_id).cast("long"))
        a = alerts.batch_alerts(done, rules, "prediction", ["batch_id"], user=username_col)
        a = a.drop("batch_id")
        a.write.mode("overwrite").parquet(f"{sink}/batches/{part}")
        alerts.alert_records(a, username_col).write.mode("overwrite").parquet(f"{sink}/alerts/{part}")
        if username_col in done.columns:
            history.prediction_runs(done, "prediction", f"batch_{batch_id}", model_name, f"{query_name}:{batch_id}", username_col) \
                .write.mode("overwrite").parquet(f"{sink}/runs/{part}")

    ckpt = f"{checkpoint_dir(spark)}/{query_name}"
    return (src.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
            .queryName(query_name).start())
