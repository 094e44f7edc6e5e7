"""Measures of predictions: ROUGE-L on characters, key points, evidence support, unfounded facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _rouge(p: pd.Series, r: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        n = common_length(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(a, b) for a, b in zip(p, r, strict=True)], dtype=float)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """Character ROUGE-L F1 of the cleaned texts; 0 where either is empty or null."""
    return F.pandas_udf(_rouge, "double")(T.answer_text(F.coalesce(prediction, F.lit(""))), T.answer_text(F.coalesce(reference, F.lit(""))))


def _within(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def key_points(text: Column, company: Column) -> Column:
    """Array of 'dimension:point' of a cleaned text; each point once, in order of its dimension."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    actions = _within(text, R.ACTIONS)
    actions = F.when(F.array_contains(actions, "补充披露"), F.array_remove(actions, "披露")).otherwise(actions)
    named = F.when(company.isNotNull() & (company != "") & text.contains(company), F.array(company)).otherwise(F.array().cast("array<string>"))
    dims = {
        "fin_item": _within(text, R.FINANCIAL_ITEMS),
        "action": actions,
        "risk_or_disclosure": F.concat(find(R.WHETHER), find(R.RATIONALE)),
        "time_scope": F.concat(_within(text, R.TIME_SCOPES), find(R.YEAR)),
        "entity": F.concat(find(R.ENTITY), named),
    }
    tag = lambda d: lambda p: F.concat(F.lit(d + ":"), p)
    return F.concat(*[F.transform(F.array_distinct(points), tag(d)) for d, points in dims.items()])


def _agree(a: Column, b: Column) -> Column:
    dim, x = F.substring_index(a, ":", 1), F.expr("1")
    dim_b = F.substring_index(b, ":", 1)
    x, y = a.substr(F.length(dim) + 2, F.length(a)), b.substr(F.length(dim_b) + 2, F.length(b))
    return (dim == dim_b) & (x.contains(y) | y.contains(x))


def matched(points: Column, others: Column) -> Column:
    """The points that equal, hold or are held by one of the others of their dimension."""
    return F.filter(points, lambda a: F.exists(others, lambda b: _agree(a, b)))


def prf(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Adds precision, recall and f1 of two point arrays: 1 if both are empty, 0 for an empty side."""
    p, r = F.col(pred), F.col(ref)
    mp, mr = F.size(matched(p, r)), F.size(matched(r, p))
    none = (F.size(p) == 0) & (F.size(r) == 0)
    df = df.withColumn("precision", F.when(none, 1.0).when(F.size(p) == 0, 0.0).otherwise(mp / F.size(p))).withColumn("recall", F.when(none, 1.0).when(F.size(r) == 0, 0.0).otherwise(mr / F.size(r)))
    s = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def lexicon(text: Column, company: Column) -> Column:
    """Names of firms in a report's cleaned text, and the company's own."""
    own = F.when(company.isNotNull() & (company != ""), F.array(company)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(R.ENTITY), F.lit(0)), own))


def supported(point: Column, evidence: Column, known: Column | None = None) -> Column:
    """Whether the evidence text supports a point: its own words; for a judgement one of the items or stems that it names; for a firm one of the ``known`` names in it. Null for actions."""
    known = F.array().cast("array<string>") if known is None else known
    dim = F.substring_index(point, ":", 1)
    p = point.substr(F.length(dim) + 2, F.length(point))
    anchors = _within(p, [*R.FINANCIAL_ITEMS, *R.RISK_STEMS])
    held = lambda names: F.exists(names, lambda a: evidence.contains(a))
    return F.when(dim == "action", None).when(dim == "risk_or_disclosure", held(anchors)).when(dim == "entity", held(F.filter(known, lambda e: p.contains(e)))).otherwise(evidence.contains(p))


def unfounded(text: Column, corpus: Column, year: Column, company: Column, known: Column) -> Column:
    """'kind:item' for the amounts, years and firms of a cleaned text that its report's text doesn't hold. Sorted, each once.

    The report's own year is founded, and so is a name that holds the company's or a known one.
    """
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    tag = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind + ":"), x))
    amounts = F.filter(find(R.AMOUNT), lambda a: ~corpus.contains(F.translate(a, "，", ",")))
    years = F.filter(find(R.YEAR), lambda y: ~corpus.contains(y) & ~F.coalesce(y.cast("int") == year, F.lit(False)))
    firms = F.filter(find(R.ENTITY), lambda e: ~corpus.contains(e) & ~F.coalesce(e.contains(company), F.lit(False)) & ~F.exists(known, lambda k: e.contains(k)))
    return F.array_sort(F.array_distinct(F.concat(tag("amount", amounts), tag("year", years), tag("entity", firms))))


def fact_rows(predictions: DataFrame, corpora: DataFrame, keys: list[str]) -> DataFrame:
    """``predictions`` (keys, p, company, report_year, pred, evidence) with supported and unsupported points, and unfounded items.

    ``corpora`` (keys, corpus, known): the cleaned text of each report and the firms named in it, found once per report. The evidence is what the
    model was given; where it is null, the whole report. A prediction without a report is kept, with an empty corpus.
    """
    x = predictions.join(corpora, keys, "left").withColumn("corpus", F.coalesce("corpus", F.lit("")))
    names = F.array_distinct(F.concat(F.coalesce("known", F.array().cast("array<string>")), lexicon(F.lit(""), F.col("company"))))
    x = x.withColumn("known", names).withColumn("basis", F.coalesce("evidence", "corpus"))
    ok = lambda p: supported(p, F.col("basis"), F.col("known"))
    x = x.withColumn("supported", F.filter("pred", lambda p: F.coalesce(ok(p), F.lit(False)))).withColumn("unsupported", F.filter("pred", lambda p: F.coalesce(~ok(p), F.lit(False))))
    return x.withColumn("unfounded", unfounded(F.col("p"), F.col("corpus"), F.col("report_year"), F.col("company"), F.col("known"))).drop("corpus", "known", "basis")


def fact_rates(rows: DataFrame, config: str = "config") -> DataFrame:
    """(config, samples, points, supported, support_rate, hallucination_rate): support over all points, null without points; samples with an unfounded item over all."""
    points = F.size("supported") + F.size("unsupported")
    g = rows.groupBy(config).agg(F.count("*").alias("samples"), F.sum(points).alias("points"), F.sum(F.size("supported")).alias("supported"), F.avg((F.size("unfounded") > 0).cast("int")).alias("hallucination_rate"))
    return g.withColumn("support_rate", F.try_divide("supported", "points"))


def group_conflicts(rows: DataFrame, config: str, prompt: str, prediction: str) -> DataFrame:
    """Input groups (config, prompt) that have more than one prediction; must be empty."""
    return rows.groupBy(config, prompt).agg(F.countDistinct(prediction).alias("predictions")).filter("predictions > 1")


def id_differences(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of both tables has, 'extra' or 'missing'; ids that occur twice are 'repeated'."""
    a, b = rows.select(key), expected.select(key).distinct()
    extra, missing = a.distinct().join(b, key, "left_anti"), b.join(a.distinct(), key, "left_anti")
    twice = a.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return extra.withColumn("side", F.lit("extra")).unionByName(missing.withColumn("side", F.lit("missing"))).unionByName(twice.withColumn("side", F.lit("repeated")))


def order_differences(rows: DataFrame, expected: DataFrame, key: str, place: str) -> DataFrame:
    """Ids whose place in order differs: both tables have (key, place)."""
    return rows.select(key, F.col(place).alias("own")).join(expected.select(key, F.col(place).alias("expected")), key).filter("own != expected")


def result_table(metrics: DataFrame, labels: dict[str, str], columns: list[str], pending: list[str], config: str = "config", mark: str = R.PENDING) -> DataFrame:
    """(place, label, columns, pending) in the order of ``labels`` (label -> configuration): figures with four places, ``mark`` for those to come."""
    rows = metrics.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(labels.items(), 1)], f"place int, label string, {config} string")
    four = [F.when(F.col(c).isNull(), mark).otherwise(F.format_string("%.4f", F.col(c).cast("double"))).alias(c) for c in columns]
    return rows.join(metrics, config, "left").select("place", "label", *four, *[F.lit(mark).alias(c) for c in pending])
