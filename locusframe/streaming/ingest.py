"""Sources that keep arriving: a file stream that admits each micro-batch into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import admission


def source_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def admit(stream: DataFrame, out: str, checkpoint: str, rules: admission.Rules = admission.Rules()) -> StreamingQuery:
    """Judged rows to out/rows, and counts of verdicts to out/counts, by batch; a batch that is run again replaces itself."""

    def take(batch: DataFrame, number: int) -> None:
        judged = admission.judged(batch, rules).withColumn("batch", F.lit(number))
        spark = batch.sparkSession
        previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").partitionBy("batch").parquet(f"{out}/rows")
        admission.counts(judged, ["batch"]).write.mode("overwrite").partitionBy("batch").parquet(f"{out}/counts")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
