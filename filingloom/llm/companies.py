"""Problem 1: splits that keep the records of one company together."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .canon import look

# Words that stand in a name field without naming a company (in their one form, upper case).
NO_NAME = {"", "-", "--", "/", "N/A", "NA", "NULL", "NONE", "NAN", "UNKNOWN", "无", "暂无", "未知", "不详", "未披露", "待核实", "待确认", "待补充", "缺失", "空", "公司名称缺失", "名称缺失", "本公司", "公司", "未填写", "未提供"}
# Special-treatment marks before a name, and legal forms after it.
TREATMENT = re.compile(r"^(?:\*|S?\*?ST|SST|PT|XD|XR|DR|退市)+")
LEGAL = re.compile(r"(?:\((?:集团|控股)\)|集团|控股)?(?:股份有限公司|有限责任公司|股份公司|有限公司)$|\((?:集团|控股)\)$")
MARKET = re.compile(r"^(?:SH|SZ|BJ|HK)?[.:]?(\d{1,6})(?:[.:]?(?:SH|SZ|BJ|SS|XSHG|XSHE|BSE))?$")


#: More splits than this are an error.
MOST_SPLITS = 1_000


def clean_name(value: str | None) -> str | None:
    """The bare name in its one form, without treatment mark and legal form; None where the value names no company."""
    name = look(value).upper()
    if name in NO_NAME:
        return None
    bare = LEGAL.sub("", TREATMENT.sub("", name))
    return None if bare in NO_NAME or not any(unicodedata.category(c)[0] == "L" for c in bare) else bare


def clean_code(value: str | None) -> str | None:
    """Six digits without market mark (leading zeros restored); None where the value is no code or only zeros."""
    m = MARKET.match(look(value).upper())
    return m[1].zfill(6) if m and m[1].strip("0") else None


def _batch(clean: Callable[[str | None], str | None]) -> Callable[[pd.Series], pd.Series]:
    """``clean`` over a batch, once for every different value."""

    def run(s: pd.Series) -> pd.Series:
        known = {x: clean(x) for x in s.unique()}
        return pd.Series([known[x] for x in s], dtype=object)

    return run


def identities(records: DataFrame, key: str = "question_id", code: str = "stock_code", company: str = "company") -> DataFrame:
    """(record, code, name): each record once, with its cleaned code and name."""
    r = records.select(F.col(key).cast("string").alias("record"), F.col(code).cast("string").alias("c"), F.col(company).cast("string").alias("n")).filter("record is not null").dropDuplicates(["record"])
    return r.withColumn("code", F.pandas_udf(_batch(clean_code), "string")("c")).withColumn("name", F.pandas_udf(_batch(clean_name), "string")("n")).select("record", "code", "name")


class Forest:
    """Union-find over strings with path halving; the least member of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a

    def links(self) -> list[tuple[str, str]]:
        return [(x, self.root(x)) for x in self.up]


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    f = Forest()
    for b in batches:
        for x, y in zip(b["a"], b["b"], strict=True):
            f.join(x, y)
    links = [x for x in f.links() if x[0] != x[1]]
    for i in range(0, len(links), 50_000):
        yield pd.DataFrame(links[i : i + 50_000], columns=["a", "b"])


def components(edges: DataFrame, local_links: int = 500_000, fan_in: int = 8) -> DataFrame:
    """(node, root) of an undirected graph ``edges`` (a, b); root is the least node of the component.

    Local forests are merged hierarchically: every partition turns its links into a spanning forest, ``fan_in`` partitions are then
    brought together, and so on. A forest has fewer links than nodes. Partitions are merged down to one only if what is left is at most
    ``local_links`` (counted); beyond that, rounds of large-star and small-star joins finish the forest without any task holding it.
    """
    links = edges.select("a", "b").filter("a != b").distinct()
    parts = max(1, links.sparkSession.sparkContext.defaultParallelism)
    links = materialize(links.repartition(parts, "a").mapInPandas(_local, "a string, b string"), "forest")
    left = links.count()
    while parts > 1 and left > 0:
        parts = max(1, parts // fan_in)
        if left > local_links * parts:
            return _stars(links)
        links = materialize(links.repartition(parts, "b").mapInPandas(_local, "a string, b string"), "forest")
        left = links.count()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: A node of more links than this is joined by salted parts in ``_stars``.
HUB = 100_000


def _to_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """``both`` (a, b) joined with ``least`` (a, m, n), one row per node; links of a hub (n > HUB) are dealt into parts, each with its own copy of the hub's row."""
    hubs = least.filter(F.col("n") > HUB)
    if hubs.isEmpty():
        return both.join(least, "a")
    parts = 64
    cold = both.join(hubs.select("a"), "a", "left_anti").join(least, "a")
    salted = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    hot = both.join(hubs.select("a"), "a", "left_semi").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).join(salted, ["a", "part"]).drop("part")
    return cold.unionByName(hot)


def _stars(links: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds until no link changes."""
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _to_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _to_least(down, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        links = materialize(small, "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def company_of(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with ``company_id``, links): codes and names are nodes, a record with both is a link.

    Code nodes come before name nodes ("c:" < "n:"), so a company's id is its least code where it has one. A record without code and
    name is a group of its own ("r:" and its key).
    """
    both = ids.filter("code is not null and name is not null").select(F.concat(F.lit("c:"), "code").alias("a"), F.concat(F.lit("n:"), "name").alias("b"))
    links = components(both)
    node = F.coalesce(F.concat(F.lit("c:"), F.col("code")), F.concat(F.lit("n:"), F.col("name")), F.concat(F.lit("r:"), F.col("record")))
    named = ids.withColumn("node", node).join(links, "node", "left").withColumn("company_id", F.coalesce("root", "node"))
    return named.select("record", "code", "name", "company_id"), links


def linked_codes(links: DataFrame) -> DataFrame:
    """(stock_code_a, stock_code_b): codes of one company, the smaller first."""
    codes = links.select("root", "node").unionByName(links.select("root", F.col("root").alias("node"))).filter("node like 'c:%'").select("root", F.substring("node", 3, 64).alias("code")).distinct()
    a, b = codes.withColumnRenamed("code", "stock_code_a"), codes.withColumnRenamed("code", "stock_code_b")
    return a.join(b, "root").filter("stock_code_a < stock_code_b").select("stock_code_a", "stock_code_b").distinct()


def _fill(need: list[float], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` rows each split gets when each goes to the split furthest below target.

    Exact, in logarithmic time: the greedy order takes the largest terms of the sequences need[j], need[j] - size, ...; all terms
    above a level found by bisection are taken, the few left one by one. Ties go to the first split.
    """
    lo, hi = min(need) - size * (count + 1.0), max(need) + size
    for _ in range(200):
        mid = (lo + hi) / 2
        taken = sum(max(0, int((x - mid) // size) + 1) for x in need)
        lo, hi = (mid, hi) if taken > count else (lo, mid)
        if hi - lo < 1e-9 * max(1.0, size):
            break
    out = [max(0, int((x - hi) // size) + 1) for x in need]
    heap = [(-(x - n * size), j) for j, (x, n) in enumerate(zip(need, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        x, j = heapq.heappop(heap)
        out[j] += 1
        heapq.heappush(heap, (x + size, j))
    return out


def assign(groups: DataFrame, targets: list[tuple[str, float]], total: int, buckets: int = 64) -> DataFrame:
    """(company_id, split) for ``groups`` (company_id, rows): largest first, each to the split furthest below its share of ``total``.

    Only the histogram of group sizes reaches the driver: at most sqrt(2 * total) rows. Groups of one size are interchangeable; they
    are numbered by hash bucket and id, so no task holds all of them, and splits take ranges of numbers.
    """
    order = sorted(targets)
    need = [share * total for _, share in order]
    spans: list[tuple[int, int, int, str]] = []
    for size, count in sorted(((r[0], r[1]) for r in groups.groupBy("rows").count().collect()), reverse=True):
        at = 0
        for j, n in enumerate(_fill(need, size, count)):
            if n:
                spans.append((size, at, at + n, order[j][0]))
                need[j] -= n * size
                at += n
    spark = groups.sparkSession
    table = spark.createDataFrame(spans or [(0, 0, 0, "")], "rows bigint, lo bigint, hi bigint, split string")
    g = groups.withColumn("bucket", F.pmod(F.xxhash64("company_id"), F.lit(buckets)))
    from pyspark.sql import Window as W

    place = g.groupBy("rows", "bucket").count().withColumn("base", F.sum("count").over(W.partitionBy("rows").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("rows", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    numbered = g.withColumn("n", F.row_number().over(W.partitionBy("rows", "bucket").orderBy("company_id"))).join(place, ["rows", "bucket"]).withColumn("n", F.col("n") - 1 + F.col("base"))
    return numbered.join(table, "rows").filter("n >= lo and n < hi").select("company_id", "split")


def company_splits(records: DataFrame, targets: DataFrame, key: str = "question_id", code: str = "stock_code", company: str = "company") -> tuple[DataFrame, DataFrame]:
    """(splits, links): (record, company_id, split) for every record once, and the forest of codes and names.

    ``targets`` (split, proportion; a few rows) is normalised to 1; null or non-positive proportions are left out. Null keys are left
    out. An empty table gives no rows.
    """
    ids = materialize(identities(records, key, code, company), "ids")
    named, links = company_of(ids)
    named = materialize(named, "companies")
    given = targets.select("split", "proportion").filter("split is not null and proportion > 0").distinct().limit(MOST_SPLITS + 1).collect()
    if len(given) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares = [(r["split"], float(r["proportion"])) for r in given]
    whole = sum(p for _, p in shares)
    groups = named.groupBy("company_id").agg(F.count("*").alias("rows"))
    given = assign(groups, [(s, p / whole) for s, p in shares], named.count())
    return named.select("record", "company_id").join(given, "company_id").select("record", "company_id", "split"), links
