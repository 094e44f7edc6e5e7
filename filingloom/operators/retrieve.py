"""Chunks of reports with page lineage, and BM25 retrieval inside a partition or over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, stored
from .blocks import BLOCK, CANDIDATES, Chunks, numbered, with_texts
from .ordered import running_sum


def report_chunks(pages: DataFrame, size: int = 750, overlap: int = 100, least: int = 50, document_type: str = "annual_report") -> DataFrame:
    """(stock_code, report_year, chunk_no, page_start, page_end, text): overlapping windows over each report's text, as ``stored_chunks`` has them."""
    c = stored_chunks(pages, size, overlap, least, document_type)
    return numbered(c.rows, c).select("stock_code", "report_year", "chunk_no", "page_start", "page_end", "text")


def stored_chunks(pages: DataFrame, size: int = 750, overlap: int = 100, least: int = 50, document_type: str = "annual_report", block: int = BLOCK) -> Chunks:
    """Overlapping windows over each report's text, in stored blocks of about ``block`` characters: one report's, or small reports together.

    Pages are normalised, empty ones skipped, and laid end to end with a line feed between. A window that holds fewer than ``least``
    characters after stripping is dropped, and numbers count the windows that are left. No report is gathered into one row or one task: page
    offsets are running sums of lengths in two levels, without the text; every page gives its piece to the two or three windows it meets,
    and a window's pieces are joined, which bounds each group by ``size`` characters. Re-delivered pages count once; null keys form a
    report of their own. Texts are moved twice: to the offset of their page, and to the block of their windows.
    """
    step = size - overlap
    report = ["stock_code", "report_year"]
    text = pages.filter(F.col("document_type") == document_type).select("document_id", F.col("page_number").alias("page"), *report, T.report_text("text").alias("t"))
    text = text.withColumn("h", F.xxhash64("t", *report))  # which delivery of a page counts, here and below
    one = text.groupBy("document_id", "page").agg(F.min(F.struct("h", F.length("t").alias("n"), *report)).alias("x")).select("document_id", "page", "x.n", *[f"x.{c}" for c in report]).filter("n > 0")
    one = materialize(one.withColumn("report", F.concat_ws("/", F.coalesce("stock_code", F.lit("")), F.coalesce("report_year", F.lit("")))), "lengths", "zstd")
    sizes = one.groupBy("report").agg(F.sum("n").alias("chars"))
    blocks = max(1, -(-int(one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // block))
    at = running_sum(one, report, F.floor(F.col("page") / 1000), ["page", "document_id"], F.col("n") + 1, "start", "total").join(sizes, "report")
    own = ["report", "start", "total", "chars"]
    kinds = dict(at.dtypes) | {"t": "string", "h": "bigint"}
    none = lambda df, names: df.withColumns({c: F.lit(None).cast(kinds[c]) for c in names})
    both = none(text, own).unionByName(none(at.select("document_id", "page", *own), [*report, "t", "h"]).select("document_id", "page", *report, "t", "h", *own))
    at = both.groupBy("document_id", "page").agg(F.min(F.when(F.col("start").isNull(), F.struct("h", "t", *report))).alias("x"), *[F.max(c).alias(c) for c in own]).filter("start is not null").select("page", "x.t", *[f"x.{c}" for c in report], *own)
    end = F.col("total") - 1
    at = at.withColumn("t", F.when(F.col("start") + F.length("t") == end, F.col("t")).otherwise(F.concat("t", F.lit("\n"))))
    last = F.greatest(F.lit(0), F.ceil((end - size) / step))  # no window begins once one has reached the end
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("start") - size + 1) / step)), F.least(last, F.floor((F.col("start") + F.length("t") - 1) / step))
    w = at.filter(lo <= hi).withColumn("w", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    cut_from = F.greatest(F.lit(0), F.col("w") * step - F.col("start"))
    cut_to = F.least(F.length("t"), F.col("w") * step + size - F.col("start"))
    key = F.xxhash64("report")
    place = F.when(F.col("chars") <= block, F.concat(F.lit("s"), F.pmod(key, F.lit(blocks)))).otherwise(F.concat(F.lit("r"), F.hex(key), F.lit("-"), F.floor(F.col("w") * step / block)))
    w = w.select(place.alias("block"), "report", *report, "w", "start", "page", F.col("t").substr((cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("piece")).filter("length(piece) > 0").repartition("block")
    blank = T.strip("piece") == ""
    g = w.groupBy("block", "report", *report, "w").agg(
        F.min(F.when(~blank, F.col("page"))).alias("page_start"),
        F.max(F.when(~blank, F.col("page"))).alias("page_end"),
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda s: s["piece"]), "")).alias("text"),
    )
    g = g.filter(F.length("text") >= least)
    root = stored(g, "windows", "block", "zstd")
    rows = pages.sparkSession.read.schema(g.schema).parquet(root)
    no = running_sum(rows.select(*report, "w"), report, F.floor(F.col("w") / 10_000), ["w"], F.lit(1), "before")
    return Chunks(root, rows, materialize(no.filter("before != w"), "shifted", "zstd"))


def bm25(docs: DataFrame, queries: DataFrame, partition: list[str], k: int = 10, k1: float = 1.5, b: float = 0.75, lead: int = 3) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query's partition; [] as ``partition`` is the whole corpus.

    docs: partition columns, doc_id, text. queries: partition columns, query_id, text. Statistics belong to the partition. Scores are
    rounded to nine places before ranking, ties go to the smaller id. Documents without a common term score 0 and fill the rank list;
    as they come in order of id, only the first k of a partition can be needed, so nothing is crossed with a whole partition.
    Empty queries and partitions without documents give no rows.

    Only postings of query terms are kept. The ``lead`` terms of the highest bound give each query a k-th best score that the result must
    reach; terms whose bounds together stay below it can't bring in a document of their own, so their postings are looked up for
    documents that can still reach that score, and never expanded by query. All bounds are exact, so no document is lost.
    """
    query_terms = queries.select(*partition, "query_id", T.token_text("text").alias("t")).select(*partition, "query_id", F.explode(T.terms("t")).alias("term"))
    q = materialize(query_terms.groupBy(*partition, "query_id", "term").agg(F.count("*").alias("qtf")), "query-terms")
    d = docs.select(*partition, "doc_id", T.token_text("text").alias("t")).select(*partition, "doc_id", T.terms("t").alias("terms"))
    d = materialize(d.withColumn("dl", F.size("terms")), "doc-terms")
    ids = d.select(*partition, "doc_id", "dl").distinct()
    post = d.select(*partition, "doc_id", "dl", F.explode("terms").alias("term")).join(q.select(*partition, "term").distinct(), [*partition, "term"], "left_semi")
    tf = materialize(post.groupBy(*partition, "doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    df = tf.groupBy(*partition, "term").agg(F.count("*").alias("df"))
    stats = ids.groupBy(*partition).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    join = lambda x, y: x.join(y, partition) if partition else x.crossJoin(F.broadcast(y))  # the statistics of one partition: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = join(q.join(df, [*partition, "term"]), stats).withColumn("w", idf * (1 + F.log("qtf"))).withColumn("bound", F.col("w") * (k1 + 1))
    up = W.partitionBy("query_id").orderBy("bound", "term")
    terms = terms.withColumn("below", F.sum("bound").over(up.rowsBetween(W.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("term"))))
    terms = materialize(terms.select(*partition, "query_id", "term", "w", "bound", "below", "nth", "avgdl"), "terms")
    avg = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    best = W.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    first = terms.filter(F.col("nth") <= lead).join(tf, [*partition, "term"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("s"))
    floor_ = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id").agg(F.max(F.when(F.col("r") == k, F.col("s"))).alias("floor"))
    terms = materialize(terms.join(floor_, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 1e-6).withColumn("needed", F.col("below") >= F.col("floor")), "bounds")
    own = terms.filter("needed").join(tf, [*partition, "term"]).groupBy(*partition, "query_id", "doc_id").agg(F.sum(part).alias("s"))
    rest = terms.filter("not needed").groupBy("query_id").agg(F.sum("bound").alias("rest"))
    floors = terms.select("query_id", "floor").distinct()
    alive = materialize(own.join(floors, "query_id").join(rest, "query_id", "left").filter(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")).select(*partition, "query_id", "doc_id", "s"), "alive")
    more = alive.join(terms.filter("not needed"), [*partition, "query_id"]).join(tf, [*partition, "term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("more"))
    scored = alive.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("score"))
    zero = ids.drop("dl").withColumn("r", F.row_number().over(W.partitionBy(*partition).orderBy("doc_id"))).filter(F.col("r") <= k).drop("r") if partition else ids.select("doc_id").orderBy("doc_id").limit(k)
    live = q.select(*partition, "query_id").distinct()
    fill = (live.join(zero, partition) if partition else live.crossJoin(F.broadcast(zero))).select("query_id", "doc_id", F.lit(0.0).alias("score"))  # k rows
    both = scored.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).withColumn("score", F.round("score", 9))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def candidate_rows(questions: DataFrame, hits: DataFrame, chunks: DataFrame | Chunks) -> DataFrame:
    """``questions`` (query_id, ...) with candidate_count, max_score and candidates: array of (rank, doc_id, page_start, page_end, score, text).

    A question without a report, or with an empty query, stays with an empty array and score 0. At most the k hits of a question are gathered.
    Stored ``chunks`` go with the hits of ``blocks.report_hits``.
    """
    if isinstance(chunks, Chunks):
        own = with_texts(hits, chunks)
    else:
        one = F.struct("rank", "doc_id", "page_start", "page_end", F.round("score", 6).alias("score"), "text")
        own = hits.join(chunks.select("doc_id", "page_start", "page_end", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).cast(CANDIDATES).alias("candidates"))
    x = questions.join(own, "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(CANDIDATES)))
    return x.withColumn("candidate_count", F.size("candidates")).withColumn("max_score", F.coalesce(F.expr("try_element_at(candidates, 1).score"), F.lit(0.0)))


def candidate_counts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``questions`` with candidate_count and max_score as ``candidate_rows`` has them, without the candidates."""
    own = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("candidate_count"), F.max(F.round("score", 6)).alias("max_score"))
    return questions.join(own, "query_id", "left").withColumns({"candidate_count": F.coalesce("candidate_count", F.lit(0)), "max_score": F.coalesce("max_score", F.lit(0.0))})


def without_candidates(rows: DataFrame) -> DataFrame:
    """Candidate rows that found nothing."""
    return rows.filter("candidate_count = 0 or max_score <= 0")


def span_pages(ranges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``ranges`` (keys, start, stop) with page_start and page_end: the pages whose spans (keys, page, from_, to_) they meet, both ends included.

    A range that meets no span gets the last span's page; null for a document without spans.
    """
    s = spans.select(*keys, "page", "from_", "to_")
    met = ranges.select(*keys, "start", "stop").distinct().join(s, keys).filter("from_ <= stop and to_ >= start").groupBy(*keys, "start", "stop").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    last = s.groupBy(*keys).agg(F.max_by("page", "from_").alias("last"))
    x = ranges.join(met, [*keys, "start", "stop"], "left").join(last, keys, "left")
    return x.withColumn("page_start", F.coalesce("page_start", "last")).withColumn("page_end", F.coalesce("page_end", "last")).drop("last")


def gold_rows(table: DataFrame, sample: str, start: str, end: str) -> DataFrame:
    """Rows of an alignment table whose sample id names a question (_Q and a number) and that have both pages, with question_number."""
    number = F.regexp_extract(sample, "_Q(\\d+)", 1)
    return table.filter(F.col(sample).rlike("_Q\\d+") & F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("question_number", number.cast("int"))


def gold_hits(gold: DataFrame, questions: DataFrame, hits: DataFrame, name: str = "company") -> DataFrame:
    """(gold_id, rank) of every retrieved chunk that meets the gold row's pages, of all questions of its company and number.

    gold: gold_id, ``name``, question_number, gold_start, gold_end; questions: query_id, ``name``, question_number.
    """
    q = gold.join(questions.select("query_id", name, "question_number"), [name, "question_number"])
    x = q.join(hits.select("query_id", "rank", "page_start", "page_end"), "query_id")
    return x.filter(ranges_meet(F.col("page_start"), F.col("page_end"), F.col("gold_start"), F.col("gold_end"))).select("gold_id", "rank")


def review_rows(candidates: DataFrame, gold: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """One row per question and its ``k`` best candidates with pages, and whether they meet the pages of the last gold row (keys, gold_id, gold_start, gold_end) of the question; null without one."""
    last = gold.groupBy(*keys).agg(F.max(F.struct("gold_id", "gold_start", "gold_end")).alias("g")).select(*keys, "g.*")
    x = candidates.join(last, keys, "left").withColumn("c", F.explode(F.slice("candidates", 1, k)))
    hit = F.when(F.col("gold_id").isNotNull(), ranges_meet(F.col("c.page_start"), F.col("c.page_end"), F.col("gold_start"), F.col("gold_end")))
    return x.select("query_id", *keys, "c.rank", "c.doc_id", T.page_range("c.page_start", "c.page_end").alias("pages"), "c.score", "c.text", "gold_id", hit.alias("hit"))


def ranges_meet(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive page ranges overlap; false with any null."""
    return F.coalesce((a_start <= b_end) & (b_start <= a_end), F.lit(False))


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, recall) over all gold rows: hits (gold_id, rank), gold (gold_id). 0 for an empty gold table."""
    best = hits.groupBy("gold_id").agg(F.min("rank").alias("rank"))
    x = gold.select("gold_id").distinct().join(best, "gold_id", "left")
    return x.agg(*[F.coalesce(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), F.lit(0.0)).alias(str(k)) for k in ks]).select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.col(str(k)) for k in ks]))).alias("k", "recall"))
