"""Row and group checks of questions and pages; one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def issues(df: DataFrame, keep: list[str], checks: dict[str, Column], name: str = "issue_type") -> DataFrame:
    """One row (keep, issue) for every check that is true; null counts as false."""
    each = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(each).alias(name))


def question_issues(q: DataFrame, parent: tuple[int, int] = (30, 5000), child: tuple[int, int] = (8, 1800), contamination: str = R.CONTAMINATION) -> DataFrame:
    """(question_id, source_file, issue_type): nine kinds of issues, several per row possible.

    Repeated keys and texts are counted by grouping and joined back, so that a text held by many rows is combined before it is shuffled.
    Only the test for texts from several files also holds for empty texts.
    """
    t = q.withColumn("t", T.strip(F.coalesce("question_text", F.lit("")))).withColumn("k", F.xxhash64(T.without_space(F.coalesce("question_text", F.lit("")))))
    ids = q.groupBy("question_id").agg(F.count("*").alias("ids"))
    texts = t.groupBy("k").agg(F.count("*").alias("texts"), F.countDistinct("source_file").alias("files"))
    x = t.join(ids, "question_id").join(texts, "k")
    n = F.length("t")
    return issues(
        x,
        ["question_id", "source_file"],
        {
            "empty_question": F.col("t") == "",
            "duplicate_question_id": F.col("ids") > 1,
            "duplicate_question_text": (F.col("t") != "") & (F.col("texts") > 1),
            "abnormal_parent_length": (F.col("question_level") == "parent") & ~n.between(*parent),
            "abnormal_subquestion_length": (F.col("question_level") == "subquestion") & ~n.between(*child),
            "possible_response_contamination": F.col("t").rlike(contamination),
            "missing_source_page": F.col("source_page_start").isNull() | F.col("source_page_end").isNull(),
            "same_question_from_multiple_files": F.col("files") > 1,
            "source_needs_manual_review": F.col("needs_review"),
        },
    )


def ocr_priority(pages: DataFrame, least: int = 50) -> DataFrame:
    """Annual-report pages that need recognition or hold little text, with the reason; re-delivered pages count once, a null count is 0."""
    count = F.coalesce("char_count", F.lit(0))
    p = pages.filter("document_type = 'annual_report'").filter(F.coalesce(F.col("extraction_status") == "needs_ocr", F.lit(False)) | (count < least))
    columns = ["company", "stock_code", "report_year", "source_file", "page_number", "char_count", "extraction_status"]
    return p.dropDuplicates(["document_id", "page_number"]).withColumn("char_count", count).select(*columns, F.when(F.col("extraction_status") == "needs_ocr", "needs_ocr").otherwise("sparse_text").alias("priority_reason"))


def parse_status(pages: DataFrame) -> DataFrame:
    """Status of each document from its pages: failed or needs_ocr if all are, partial_needs_ocr if any is either, else success."""
    p = pages.select("document_id", "page_number", "extraction_status").dropDuplicates(["document_id", "page_number"])
    g = p.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("extraction_status") == "failed").alias("failed"), F.count_if(F.col("extraction_status") == "needs_ocr").alias("ocr"))
    s = F.when(F.col("failed") == F.col("pages"), "failed").when(F.col("ocr") == F.col("pages"), "needs_ocr").when(F.col("failed") + F.col("ocr") > 0, "partial_needs_ocr").otherwise("success")
    return g.select("document_id", "pages", s.alias("parse_status"))
