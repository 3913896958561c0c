"""The work queue as a stream: documents arrive as files, each is redacted once, counts are kept by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.plans import detection


def arrivals(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """A stream of documents from Parquet files as they appear; a trigger takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def redacted_stream(docs: DataFrame, mask_salary: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents found, judged, redacted and verified as they arrive: document_id, text, n_findings, outcome.

    No state, so any number of them. A document that fails verification keeps its row but gives no text.
    """
    done = detection.judged(detection.documents_of(docs, id_col, text_col), mask_salary)
    text = F.when(F.col("verdict.outcome") != "failed", F.array_join(F.transform("outputs", lambda o: o["redacted"]), "\n"))
    return done.select(F.col("document_id").alias(id_col), text.alias(text_col), F.size("findings").alias("n_findings"), F.col("verdict.outcome").alias("outcome"))


def start(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet until what has arrived is done; the checkpoint makes a rerun continue, not repeat."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queued(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Deliveries (document_id, attempt, at), each once: repeats within the watermark are dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["document_id", "attempt"])
