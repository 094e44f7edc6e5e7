"""Readers and writers: raw documents, JSON lines, CSV, write-once copies, pluggable page extraction and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..session import materialize


def manifest(paths: DataFrame, path: str = "relative_path") -> DataFrame:
    """Roles from a path <root>/<code>_<company>/<role>/[<subtype>/]<file>: code, company, document type, subtype, year, document_id."""
    parts = F.split(F.col(path), "/")
    folder, file = parts.getItem(1), F.element_at(parts, -1)
    n = F.size(parts)
    role = F.when(n > 2, parts.getItem(2)).otherwise(F.lit(""))
    kind = F.when(F.upper(file).contains("MISSING"), "missing_notice").when(role.isin("annual_report", "inquiry", "reply", "supporting"), role).otherwise("unknown")
    subtype = F.when((kind == "supporting") & (n > 4), parts.getItem(3)).otherwise(F.lit(""))
    year = F.coalesce(F.nullif(F.regexp_extract(file, "20\\d{2}", 0), F.lit("")), F.lit("2024"))
    code = F.substring_index(folder, "_", 1)
    tail = F.substring(F.sha1(F.col(path)), 1, 8)
    notice = F.when(kind == "missing_notice", role).otherwise(F.lit(""))
    doc = F.concat_ws("_", *[F.nullif(x, F.lit("")) for x in (code, year, kind, notice, subtype, tail)])
    return paths.select(path, code.alias("stock_code"), folder.substr(F.length(code) + 2, F.length(folder)).alias("company"), kind.alias("document_type"), subtype.alias("supporting_subtype"), year.alias("report_year"), file.alias("filename"), doc.alias("document_id"))


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below ``root`` in order of their paths: path, relative_path (from the root's own name on), length, modificationTime (and content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    df = df.withColumn("relative_path", F.concat(F.lit(name), F.expr(f"substring(path, instr(path, '/{name}/') + {len(name) + 1})")))
    return (df if content else df.drop("content")).orderBy("relative_path")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).dropna(how="all")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a header, in this order of columns; columns that are missing are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).na.fill("").write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def copy_once(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` where nothing is yet, and reads what is there."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable[str | Exception]], suffix: str = "", least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of files (path, content) by an injected extractor, which runs once per file: the result is stored.

    The extractor gives each page's text, or an exception for a page that fails. Files that don't end with ``suffix`` (as .pdf) are skipped. A file that
    can't be opened is a failure without page; a page that fails, or that has under ``least`` characters, is one with its number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                at = 0
                try:
                    for at, t in enumerate(extractor(content), 1):
                        rows.append((path, at, "", str(t)[:200]) if isinstance(t, Exception) else (path, at, t, None))
                except Exception as e:  # the reason goes to the side output
                    rows.append((path, at + 1 if at else None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw", "reason"]).astype({"page_number": "Int32"})

    out = files.filter(F.lower("path").endswith(suffix)).select("path", "content").mapInPandas(run, "path string, page_number int, raw string, reason string")
    out = out.withColumn("text", T.clean_page_text("raw"))
    status = F.when(F.col("reason").isNotNull(), "failed").otherwise(T.page_status("text", least))
    out = materialize(out.select("path", "page_number", "text", F.length("text").alias("char_count"), status.alias("extraction_status"), "reason"), "extracted")
    failures = out.filter("extraction_status != 'success'").select("path", "page_number", F.when(F.col("page_number").isNull(), "open_failed").when(F.col("reason").isNotNull(), "page_failed").otherwise("needs_ocr").alias("failure_type"), "reason")
    return out.filter("page_number is not null and text is not null").drop("reason"), failures


def score_batches(df: DataFrame, scorer: Callable[[list[str]], list], text: str, kind: str, name: str = "score") -> DataFrame:
    """Adds what an injected model (generator, embedder, scorer) gives for each batch of texts."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(s)))

    return df.withColumn(name, F.pandas_udf(run, kind)(F.col(text)))


def score_pairs(df: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], left: str, right: str, name: str = "score") -> DataFrame:
    """Adds what an injected model of text pairs (prediction, reference) gives, a batch at a time; null texts are empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer([x or "" for x in a], [x or "" for x in b]), dtype=float)

    return df.withColumn(name, F.pandas_udf(run, "double")(F.col(left), F.col(right)))
