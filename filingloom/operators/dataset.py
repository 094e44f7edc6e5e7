"""Training samples: evidence, chat messages, splits, leakage, label masking and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..session import materialize


def training_targets(q: DataFrame) -> DataFrame:
    """Sub-questions that are marked as targets and not excluded; null marks fail."""
    return q.filter("question_level = 'subquestion' and is_training_target is true and exclude_from_training is false")


def routed_sources(filings: DataFrame, priority: dict[str, int] = R.SOURCE_PRIORITY, subtypes: dict[str, int] = R.SUBTYPE_PRIORITY, other: int = R.OTHER_PRIORITY) -> DataFrame:
    """The documents used per stock code: all of the first kind present, but only one of the last kind, by subtype priority and path.

    Subtypes that ``subtypes`` doesn't name get ``other``; null counts as "". Missing and failed documents are left out.
    """
    rank = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    f = filings.filter("not is_missing and parse_status != 'failed'").withColumn("priority", F.try_element_at(rank(priority), "document_type")).filter("priority is not null")
    best = f.groupBy("stock_code").agg(F.min("priority").alias("best"))
    f = f.join(best, "stock_code").filter("priority = best").drop("best")
    sub = F.coalesce(F.try_element_at(rank(subtypes), F.coalesce("supporting_subtype", F.lit(""))), F.lit(other))
    one = f.filter(F.col("priority") == max(priority.values())).groupBy("stock_code").agg(F.min(F.struct(sub.alias("s"), "relative_path")).alias("x")).select("stock_code", "x.relative_path")
    return f.filter(F.col("priority") < max(priority.values())).unionByName(f.join(one, ["stock_code", "relative_path"], "left_semi"))


def evidence_block(candidates: Column, k: int = 3) -> Column:
    """The k best candidates, each under a line with its number, pages and id; "" without any."""
    a, b, c, d = (F.lit(x) for x in R.EVIDENCE_HEAD)
    part = lambda x, i: F.concat(a, i + 1, b, F.coalesce(T.page_range(x["page_start"], x["page_end"]), F.lit("")), c, x["doc_id"], d, F.lit("\n"), T.strip(x["text"]))
    return F.array_join(F.transform(F.slice(candidates, 1, k), part), "\n")


def exportable(rows: DataFrame, text: str = "question_text") -> DataFrame:
    """Candidate rows with a candidate and a text that isn't blank."""
    return rows.filter((F.col("candidate_count") > 0) & (T.strip(F.coalesce(text, F.lit(""))) != ""))


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def chat_samples(rows: DataFrame, system: str, with_evidence: str, without: str | None = None, k: int = 3, source: str = "bm25_top", text: str = "question_text", values: tuple[str, ...] = ("company", "stock_code", "report_year", "risk_topic"), more: dict[str, Column] | None = None) -> DataFrame:
    """(sample_id, messages, metadata) of candidate rows (query_id, candidates, ``text``, ...): the gold text stands in the assistant's turn only.

    The templates are filled with {evidence} and those of ``values`` that the rows have. Rows without candidates take ``without``, if it is
    given. metadata has the values, ``more``, and of the k candidates used: number, ids, page ranges, the companies they come from, and ``source``.
    """
    used = F.slice("candidates", 1, k)
    known = {v: F.col(v) for v in values if v in rows.columns}
    user = T.fill(with_evidence, evidence=evidence_block(F.col("candidates"), k), **known)
    if without is not None:
        user = F.when(F.size("candidates") > 0, user).otherwise(T.fill(without, evidence=F.lit(""), **known))
    owner = F.array_sort(F.array_distinct(F.transform(used, lambda x: F.substring_index(x["doc_id"], "/", 1))))
    meta = F.struct(
        *[c.alias(v) for v, c in {**known, **(more or {})}.items()],
        F.size(used).alias("evidence_top_k"),
        F.transform(used, lambda x: x["doc_id"]).alias("evidence_chunk_ids"),
        F.transform(used, lambda x: F.coalesce(T.page_range(x["page_start"], x["page_end"]), F.lit(""))).alias("evidence_page_ranges"),
        owner.alias("evidence_companies"),
        F.lit(source).alias("source"),
    )
    return rows.select(F.col("query_id").alias("sample_id"), chat_messages(F.lit(system), user, F.coalesce(text, F.lit(""))).alias("messages"), meta.alias("metadata"))


def first_samples(samples: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """The first ``n`` samples in the given order, for a dry run."""
    return samples.orderBy(order).limit(n)


def entity_splits(rows: DataFrame, assignment: DataFrame, key: str = "stock_code", split: str = "split", strict: bool = True) -> DataFrame:
    """``rows`` with their key's split. A key that stands in two splits raises; so does a row whose key has none, if ``strict``, when it is read.

    The assignment is joined by key; Spark broadcasts it only below its checked size.
    """
    one = assignment.groupBy(key).agg(F.min(split).alias(split), F.countDistinct(split).alias("__n"))
    what = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    x = rows.drop(split).join(one, key, "left" if strict else "inner")
    x = x.withColumn(split, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("more than one split: "), what)).cast("string")).otherwise(F.col(split)))
    if strict:
        x = x.withColumn(split, F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no split: "), what)).cast("string")).otherwise(F.col(split)))
    return x.drop("__n")


def unassigned(rows: DataFrame, assignment: DataFrame, key: str = "stock_code") -> DataFrame:
    """Keys of ``rows`` that have no split."""
    return rows.select(key).distinct().join(assignment.select(key).distinct(), key, "left_anti")


def split_overlaps(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def gold_windows(gold: DataFrame, inputs: DataFrame, width: int = 15, stride: int = 5) -> DataFrame:
    """(gold_id, input_id): a window of ``width`` characters of the gold text, at every ``stride``, stands in the input.

    Every place of an input gives a key and so does every window, and both meet in an equi-join on the window itself; no input is scanned
    per gold text. A gold text shorter than a window is one window of its own length, and inputs give keys of every such length that
    occurs. Empty texts match nothing.
    """
    g = gold.filter("length(text) > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - width - 1), F.lit(stride))))
    g = g.select("gold_id", F.col("text").substr(F.col("at") + 1, F.lit(width)).alias("w")).distinct()
    sizes = g.select(F.length("w").cast("int").alias("size")).distinct()  # at most ``width`` rows
    i = inputs.join(F.broadcast(sizes), F.length("text") >= F.col("size")).withColumn("at", F.explode(F.sequence(F.lit(0), F.length("text") - F.col("size"))))
    i = i.select("input_id", F.col("text").substr(F.col("at") + 1, F.col("size")).alias("w"))
    return g.join(i, "w").select("gold_id", "input_id").distinct()


def default_map(rows: DataFrame, key: str, mapping: DataFrame, value: str, default: str) -> DataFrame:
    """Rows with ``value`` from the mapping (key, value), or the default."""
    return rows.join(mapping, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def masked_labels(prompt: Column, answer: Column, longest: int) -> tuple[Column, Column]:
    """(input ids, labels): prompt labels are -100; beyond ``longest`` tokens the left is dropped."""
    ids = F.concat(prompt, answer)
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer)
    cut = lambda x: F.when(F.size(x) > longest, F.slice(x, -longest, longest)).otherwise(x)
    return cut(ids), cut(labels)


def padded(x: Column, width: Column, pad: int) -> Column:
    """The array with ``pad`` on the right up to ``width``."""
    return F.concat(x, F.array_repeat(F.lit(pad), (width - F.size(x)).cast("int")))


def collated(samples: DataFrame, batch: int, order: str = "sample_id", pad: int = 0) -> DataFrame:
    """``samples`` (order, ids, labels) with batch, ids, labels and mask padded on the right to the longest of their batch; -100 pads labels.

    Batches count the rows in order; rows are numbered by range partitions, so no task holds them all.
    """
    x = _numbered(samples, order).withColumn("batch", F.floor(F.col("place") / batch))
    x = x.join(x.groupBy("batch").agg(F.max(F.size("ids")).alias("width")), "batch")
    mask = padded(F.array_repeat(F.lit(1), F.size("ids")), F.col("width"), 0)
    return x.select(order, "batch", mask.alias("mask"), padded(F.col("ids"), F.col("width"), pad).alias("ids"), padded(F.col("labels"), F.col("width"), -100).alias("labels"))


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with its place from 0 in the order: sorted by range, numbered inside each part, parts added up."""
    s = df.select(order).orderBy(order).withColumn("part", F.spark_partition_id())
    s = materialize(s.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1), "places")
    base = s.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per part
    return df.join(s.join(base, "part").select(order, (F.col("base") + F.col("nth")).alias("place")), order)


def accumulation(steps: int, world: int) -> int:
    """Gradient accumulation steps per process."""
    return max(1, steps // max(1, world))
