"""The batch operators over streams: pages are cleaned as they arrive, re-deliveries are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def arriving_pages(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Cleaned pages once each: a re-delivery within ``late`` of the newest page is dropped, state is bounded by the watermark."""
    once = stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["document_id", "page_number"])
    return once.withColumn("text", T.clean_page_text("text")).withColumn("extraction_status", T.page_status("text"))


def status_counts(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Pages per day of arrival and status."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "extraction_status").count()
