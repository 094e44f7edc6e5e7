"""Queries of the ten training-data problems over the project's tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship, table
from . import canon, companies, cutoff, leaks, lines, overlap, packing, pairs, scans, unsafe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


# 3. Visually identical text with different characters


def _page_key():
    return F.concat(F.col("document_id"), F.lit(":"), F.col("page_number").cast("string"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "question_records").filter("length(question_text) > 20 and question_id is not null")
    p = table(spark, sf_dir, "page_records").filter("text is not null and document_id is not null and page_number is not null")
    qk = canon.form_keys(q, "question_text", [F.lit("question").alias("record_kind"), F.col("question_id").alias("key")])
    pk = canon.form_keys(p, "text", [F.lit("page").alias("record_kind"), _page_key().alias("key")]).filter("visible >= 40")
    return canon.same_look_pairs(materialize(qk.unionByName(pk).drop("visible"), "forms"))


@query
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose look has more than one spelling, with its class and how many records and spellings that has."""
    q = table(spark, sf_dir, "question_records").filter("question_text is not null and question_id is not null")
    p = table(spark, sf_dir, "page_records").filter("text is not null and document_id is not null and page_number is not null")
    qk = canon.form_keys(q, "question_text", [F.lit("question").alias("record_kind"), F.col("question_id").alias("key")])
    pk = canon.form_keys(p, "text", [F.lit("page").alias("record_kind"), _page_key().alias("key")])
    return canon.look_classes(materialize(qk.unionByName(pk).filter("visible > 0"), "forms"))


@query
def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question text and page text in its one form."""
    q = table(spark, sf_dir, "question_records").select(F.lit("question").alias("record_kind"), F.col("question_id").alias("key"), F.col("question_text").alias("text"))
    p = table(spark, sf_dir, "page_records").select(F.lit("page").alias("record_kind"), _page_key().alias("key"), "text")
    return canon.one_form(q.unionByName(p), "text", [F.col("record_kind"), F.col("key")])


# 6. Lines repeated across one source's pages


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "page_records"))[0]


@query
def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more frequent lines are inside their source than outside: pages, log-likelihood ratio, and whether that is significant; lines on two pages or more."""
    rows = lines.repeated_lines(table(spark, sf_dir, "page_records"))[1]
    return lines.line_scores(rows, 2)


@query
def p6_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, without its repeated lines."""
    pages = table(spark, sf_dir, "page_records")
    return lines.without_lines(pages, lines.repeated_lines(pages)[0])


# 1. Splits that keep related records together


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = materialize(companies.identities(table(spark, sf_dir, "question_records")), "ids")
    return companies.linked_codes(companies.company_of(ids)[1])


@query
def p1_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code and name with its company and the number of its questions."""
    ids = materialize(companies.identities(table(spark, sf_dir, "question_records")), "ids")
    return companies.company_of(ids)[0].groupBy("company_id", "code", "name").agg(F.count("*").alias("questions"))


@query
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its company and split."""
    return companies.company_splits(table(spark, sf_dir, "question_records"), table(spark, sf_dir, "split_targets"))[0].withColumnRenamed("record", "question_id")


# 7. Same or near-same records across splits


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "split_samples").select(F.col("sample_id").alias("question_id"), "split").dropDuplicates(["question_id"])
    return overlap.split_overlaps(table(spark, sf_dir, "question_records"), "question_id", "split", ["question_text", "parent_question_text"], splits=s)


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _overlaps(spark, sf_dir)
    return x.select(F.least("key_train", "key_eval").alias("question_id_a"), F.greatest("key_train", "key_eval").alias("question_id_b")).distinct()


@query
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample that occurs on the other side of the split, with the number of samples there that agree with it."""
    x = _overlaps(spark, sf_dir).select("key_train", "key_eval").distinct()
    both = x.select(F.col("key_train").alias("sample_id"), F.lit("train").alias("side")).unionByName(x.select(F.col("key_eval").alias("sample_id"), F.lit("evaluation").alias("side")))
    return both.groupBy("sample_id", "side").agg(F.count("*").alias("links"))


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation samples per split and source_file."""
    src = table(spark, sf_dir, "split_samples").select(F.col("sample_id").alias("key_eval"), "split", F.col("metadata.source_file").alias("source_file")).dropDuplicates(["key_eval"])
    pairs = _overlaps(spark, sf_dir).select("key_train", "key_eval").distinct()
    return pairs.join(src, "key_eval").groupBy("split", "source_file").agg(F.countDistinct("key_eval").alias("samples"), F.count("*").alias("pairs"))


# 9. Evaluation texts leaking into training text


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = leaks.passage_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.leaked_items(m).select("doc_id", "item_id")


@query
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with its passages per document."""
    return leaks.leaked_items(leaks.passage_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


# 2. Text cut off by field limits


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_scores(table(spark, sf_dir, "predictions"), "config", "sample_id", "prediction", "reference")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).filter("cut").select(F.col("source").alias("config"), F.col("key").alias("sample_id"))


@query
def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut predictions for every config."""
    return _cuts(spark, sf_dir).groupBy(F.col("source").alias("config")).agg(F.count("*").alias("predictions"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("share"))


# 5. Broken prompt and response pairs


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "predictions")).select(F.col("source").alias("config"), F.col("key").alias("sample_id"), "defect")


# 10. Abusive, hateful or sexual content


def _unsafe(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = unsafe.train(docs, table(spark, sf_dir, "doc_labels"))
    return unsafe.scores(docs, weights, [F.col(c) for c in keep])


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unsafe(spark, sf_dir, "doc_id").filter(F.col("score") >= unsafe.UNSAFE).select("doc_id").distinct()


@query
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and its worst sentence."""
    return _unsafe(spark, sf_dir, "doc_id", "source")


@query
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of unsafe documents for every source."""
    return _unsafe(spark, sf_dir, "source").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= unsafe.UNSAFE).alias("unsafe"), F.avg((F.col("score") >= unsafe.UNSAFE).cast("int")).alias("rate"))


# 8. Filling fixed-capacity containers with items


@query
def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or part of a longer one) for every capacity."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of every container."""
    return packing.fills(packing.packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows")))


# 4. Noise in text from scanned pages


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scans.scanned_noise(table(spark, sf_dir, "page_records"), repair=False)
    return n.select("document_id", "page_number", F.explode("noise").alias("noise"))


@query
def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once with its noise; a scanned page as readable paragraphs, any other as it is.

    Scanned is a page with noise, one whose extraction didn't succeed, and one listed for recognition with fewer characters than it has now.
    """
    pages = table(spark, sf_dir, "page_records").filter("document_id is not null and page_number is not null").dropDuplicates(["document_id", "page_number"])
    first = table(spark, sf_dir, "ocr_priority_pages").groupBy("source_file", "page_number").agg(F.min("char_count").alias("first_count"))
    state = pages.select("document_id", "page_number", "source_file", "extraction_status", F.length("text").alias("now")).join(first, ["source_file", "page_number"], "left")
    n = scans.scanned_noise(pages).join(state, ["document_id", "page_number"])
    scanned = (F.size("noise") > 0) | F.coalesce(F.col("extraction_status") != "success", F.lit(False)) | F.coalesce(F.col("first_count") < F.col("now"), F.lit(False))
    return n.select("document_id", "page_number", F.array_join("noise", ",").alias("noise"), scans.paragraphs(F.col("text"), scanned & (F.size("noise") == 0)).alias("text"), scanned.alias("scanned"))
