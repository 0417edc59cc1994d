"""The gate and the key extraction over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.operators.keys import CONFIDENCE, KIND, references
from lettermill.operators.privacy import gate


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def gated(attachments: DataFrame) -> DataFrame:
    """Arriving attachment metadata without what must not be stored, and
    without attachments that have no name: the batch gate's rule. No checkpoint
    or sink behind it ever sees the rest."""
    return gate(attachments)[0]


def streamed_keys(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Keys of arriving messages, one for each message and reference within
    ``delay`` of ``sent_at``; state older than that is dropped."""
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    msg = F.coalesce(F.nullif(F.col("message_id").cast("string"), F.lit("")), F.col("id").cast("string"))
    rows = messages.withWatermark("sent_at", delay).select("id", "sent_at", msg.alias("msg"), F.explode(references(text)).alias("value"))
    rows = rows.dropDuplicatesWithinWatermark(["msg", "value"])
    return rows.select(F.col("id").alias("email_id"), F.lit(KIND).alias("kind"), "value", F.lit(CONFIDENCE).alias("confidence"))
