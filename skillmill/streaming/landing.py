"""Documents as they arrive in a folder, through the same functions as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_pdf_name
from ..plans.pipeline import Inputs, analyse
from ..sources.pdf import Extractor, read_pdfs, simple_extractor


def pdf_stream(spark: SparkSession, folder: str, extractor: Extractor = simple_extractor, files_per_trigger: int = 1000) -> DataFrame:
    """A stream ``doc_id, text, num_pages, status, error`` of the PDF files that land in ``folder``; other files are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return read_pdfs(files.where(is_pdf_name("path")), extractor).withColumnRenamed("path", "doc_id")


def text_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """A stream of Parquet files with documents."""
    return spark.readStream.schema(schema).parquet(folder)


def analyse_stream(docs: DataFrame, entries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Analyses each micro-batch as a batch, so that no state is kept, and gives (result, batch number) to ``sink``.

    A document without text has empty arrays, as in a batch. A batch may be given again after a failure: a sink that writes by batch number makes the whole exactly once.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(analyse(Inputs(batch.select("doc_id", "text"), entries)), number)

    writer = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
