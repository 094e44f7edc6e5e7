"""BM25 inside reports: chunks lie in stored blocks, which tasks read where they search them, so that neither texts nor postings are moved."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import materialize, stored

#: Characters of the chunks of one block, and queries that a task takes for it.
BLOCK, QUERIES = 2_000_000, 2_000
LATIN = re.compile(r"[a-z0-9]+(?:[.,][a-z0-9]+)*%?")
BLANKS, BREAK, BETWEEN = re.compile("[ \t\r\f\v　]+"), re.compile(f"{R.WS}*\n{R.WS}*"), re.compile(f"(?<={R.HAN}){R.WS}+(?={R.HAN})")
HIT = "query_id string, report string, stock_code string, report_year string, w bigint, page_start int, page_end int, score double, block string, part int"
CANDIDATES = "array<struct<rank:int,doc_id:string,page_start:int,page_end:int,score:double,text:string>>"


class Chunks(NamedTuple):
    """root: the folder of the blocks; rows: block, report, stock_code, report_year, w, page_start, page_end, text; shifted: (stock_code, report_year, w, before) of windows whose number isn't w + 1."""

    root: str
    rows: DataFrame
    shifted: DataFrame


def numbered(x: DataFrame, chunks: Chunks) -> DataFrame:
    """``x`` (stock_code, report_year, w, ...) with chunk_no. Few windows are dropped before others, so what is joined is small."""
    s = chunks.shifted.select(F.col("stock_code").alias("__code"), F.col("report_year").alias("__year"), F.col("w").alias("__w"), "before")
    on = F.col("stock_code").eqNullSafe(F.col("__code")) & F.col("report_year").eqNullSafe(F.col("__year")) & (F.col("w") == F.col("__w"))
    return x.join(s, on, "left").withColumn("chunk_no", (F.coalesce("before", "w") + 1).cast("int")).drop("__code", "__year", "__w", "before")


def latin_code(term: str) -> int:
    """Above all codes of ideographs."""
    return int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "big") >> 2 | 1 << 62


def term_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of ``functions.text.tokens`` as numbers, and the text of each: ideographs by their code points, other terms by a hash."""
    norm = [BETWEEN.sub("", BREAK.sub("", BLANKS.sub(" ", t))).lower() for t in texts]
    sizes = np.fromiter(map(len, norm), np.int64, len(norm))
    c = np.frombuffer("".join(norm).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(norm)), sizes)
    han = (c >= 0x4E00) & (c <= 0x9FFF)
    both = han[1:] & han[:-1] & (text[1:] == text[:-1])
    pairs = np.flatnonzero(both)
    alone = han.copy()
    alone[1:] &= ~both
    alone[:-1] &= ~both
    singles = np.flatnonzero(alone)
    known: dict[str, int] = {}
    codes, of = [], []
    for i, t in enumerate(norm):
        for m in LATIN.findall(t):
            m = m.replace(",", "")
            for x in (m, m[:-1]) if m[-1] == "%" else (m,):
                if x not in known:
                    known[x] = latin_code(x)
                codes.append(known[x])
                of.append(i)
    return np.concatenate([c[pairs] << 21 | c[pairs + 1], c[singles], np.array(codes, np.int64)]), np.concatenate([text[pairs], text[singles], np.array(of, np.int64)])


class Index:
    """Postings of texts in the order of their terms."""

    def __init__(self, texts: list[str]):
        codes, of = term_codes(texts)
        self.size, self.dl = len(texts), np.bincount(of, minlength=len(texts))
        self.terms, at = np.unique(codes, return_inverse=True)
        both, tf = np.unique(at * max(1, self.size) + of, return_counts=True)
        self.doc, self.tf = both % max(1, self.size), tf.astype(float)
        self.start = np.searchsorted(both, np.arange(len(self.terms) + 1) * max(1, self.size))
        self.df = np.diff(self.start)

    def weigh(self, df: np.ndarray, n: int, average: float, k1: float, b: float) -> None:
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.impact = np.repeat(idf, self.df) * self.tf * (k1 + 1) / (self.tf + k1 * (1 - b + b * self.dl[self.doc] / (average or 1.0)))

    def best(self, codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best texts and their scores; equal scores in the order of the texts."""
        at = np.minimum(np.searchsorted(self.terms, codes), max(0, len(self.terms) - 1))
        there = self.terms[at] == codes if len(self.terms) else np.zeros(len(codes), bool)
        at, more = at[there], 1 + np.log(counts[there])
        lo, n = self.start[at], self.df[at]
        post = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s = np.bincount(self.doc[post], self.impact[post] * np.repeat(more, n), self.size)
        r = np.round(s, 9)
        some = np.flatnonzero(r >= np.partition(r, self.size - k)[self.size - k]) if self.size > k else np.arange(self.size)
        some = some[np.argsort(-r[some], kind="stable")][:k]
        return some, s[some]


def read_block(root: str, name: str, reports: list[str], columns: list[str]) -> dict[str, dict[str, list]]:
    """For each of ``reports`` in a stored block the columns of its windows, in their order."""
    files, path = fs.FileSystem.from_uri(f"{root}/{name}")
    x = pq.read_table(path, columns=["report", *columns], filesystem=files, partitioning=None, use_threads=False, filters=[("report", "in", reports)]).sort_by([("report", "ascending"), ("w", "ascending")])
    if not x.num_rows:
        return {}
    of = x["report"].combine_chunks().dictionary_encode()
    first = np.flatnonzero(np.diff(of.indices.to_numpy(), prepend=-1)).tolist()
    return {r: x.slice(a, b - a).to_pydict() for r, a, b in zip(of.dictionary.to_pylist(), first, [*first[1:], x.num_rows], strict=True)}


def report_hits(chunks: Chunks, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score, page_start, page_end, report, stock_code, report_year, w, block, part, whole): the k best chunks of each query's report.

    queries: report, query_id, text. As ``retrieve.bm25`` by report: every chunk of the report is scored, also with 0, scores are rounded to nine
    places, ties go to the smaller id; queries without terms and reports without chunks give no rows. A task holds one block and QUERIES
    queries. A report that lies in several blocks has its document frequencies summed up first and its best of each block joined.
    ``whole`` says that all rows of a query come from one block.
    """
    root = chunks.root
    where = chunks.rows.groupBy("block", "report").agg(F.count("*").alias("n"))
    where = where.join(where.groupBy("report").agg(F.count("*").cast("int").alias("blocks")), "report")
    asked = queries.groupBy("report").agg(F.count("*").alias("asked"))
    where = materialize(where.join(asked, "report"), "where")
    parts = where.groupBy("block").agg(F.ceil(F.sum("asked") / QUERIES).cast("int").alias("parts"))
    where = materialize(where.join(parts, "block").select("block", "report", "blocks", "parts"), "where", "zstd")
    several = where.filter("blocks > 1").select("block", "report", F.hex(F.xxhash64("report")).alias("of"))
    counts = ""
    if not several.isEmpty():

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, report, of in zip(*(batch.column(c).to_pylist() for c in ("block", "report", "of")), strict=True):
                    x = Index(read_block(root, f"block={block}", [report], ["w", "text"])[report]["text"])
                    codes, n = np.concatenate([x.terms, [-1, -2]]), np.concatenate([x.df, [x.size, x.dl.sum()]])  # also the number of chunks and of terms
                    yield pa.RecordBatch.from_arrays([pa.array([of] * len(n)), pa.array([report] * len(n)), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["of", "report", "code", "n"])

        each = several.repartition(max(1, several.count()), "block").mapInArrow(count, "of string, report string, code bigint, n bigint")
        counts = stored(each.groupBy("of", "report", "code").agg(F.sum("n").alias("n")).repartition("of"), "frequencies", "of", "zstd")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        block, part = key[0].as_py(), key[1].as_py()
        asks: dict[str, list] = {}
        for report, blocks, of, q, t in zip(*(table[c].to_pylist() for c in ("report", "blocks", "of", "query_id", "text")), strict=True):
            asks.setdefault(report, []).append((blocks, of, q, t))
        out = []
        for report, x in read_block(root, f"block={block}", sorted(asks), ["stock_code", "report_year", "w", "page_start", "page_end", "text"]).items():
            index, own = Index(x["text"]), asks[report]
            df, n, total = index.df, index.size, index.dl.sum()
            if own[0][0] > 1:
                files, path = fs.FileSystem.from_uri(f"{counts}/of={own[0][1]}")
                f = pq.read_table(path, filesystem=files, partitioning=None, use_threads=False, filters=[("report", "=", report)]).sort_by("code")
                codes, sums = f["code"].to_numpy(), f["n"].to_numpy()
                total, n, df = sums[0], sums[1], sums[np.searchsorted(codes, index.terms)]
            index.weigh(df, n, total / n, k1, b)
            codes, of = term_codes([q[3] for q in own])
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(len(own) + 1))
            for i, (_, _, q, _) in enumerate(own):
                if cut[i] < cut[i + 1]:
                    docs, scores = index.best(*np.unique(codes[order[cut[i] : cut[i + 1]]], return_counts=True), k)
                    out += [(q, report, *(x[c][d] for c in ("stock_code", "report_year", "w", "page_start", "page_end")), s, block, part) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=[c.split(" ")[0] for c in HIT.split(", ")])

    q = queries.select("report", "query_id", F.coalesce("text", F.lit("")).alias("text")).join(where, "report")
    q = q.select("block", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "report", "blocks", F.hex(F.xxhash64("report")).alias("of"), "query_id", "text")
    found = numbered(q.groupBy("block", "part").applyInArrow(search, HIT), chunks).withColumn("score", F.round("score", 9))
    found = found.withColumn("doc_id", F.concat_ws("#", "report", F.format_string("%05d", "chunk_no")))
    query = W.partitionBy("query_id")
    found = found.withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return found.withColumn("whole", F.min("block").over(query) == F.max("block").over(query)).drop("chunk_no")


def with_texts(hits: DataFrame, chunks: Chunks) -> DataFrame:
    """(query_id, candidates) of rows of ``report_hits``: each task reads a block; only queries whose chunks lie in several blocks are put together once more."""
    root = chunks.root
    names = ("rank", "doc_id", "page_start", "page_end", "score")

    def look_up(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("query_id", "ascending"), ("rank", "ascending")]).to_pylist()
        x = read_block(root, f"block={key[0].as_py()}", sorted({r["report"] for r in rows}), ["stock_code", "report_year", "w", "text"])
        texts = {(a, b, w): t for v in x.values() for a, b, w, t in zip(v["stock_code"], v["report_year"], v["w"], v["text"], strict=True)}
        out: dict[str, list] = {}
        for r in rows:
            out.setdefault(r["query_id"], []).append({c: r[c] for c in names} | {"text": texts[r["stock_code"], r["report_year"], r["w"]]})
        whole = {r["query_id"]: r["whole"] for r in rows}
        one = pa.struct([("rank", pa.int32()), ("doc_id", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("score", pa.float64()), ("text", pa.string())])
        return pa.Table.from_arrays([pa.array(list(out), pa.string()), pa.array(list(whole.values()), pa.bool_()), pa.array(list(out.values()), pa.list_(one))], names=["query_id", "whole", "candidates"])

    h = hits.select("query_id", "report", "stock_code", "report_year", "w", "block", "part", "whole", F.col("rank").cast("int").alias("rank"), "doc_id", "page_start", "page_end", F.round("score", 6).alias("score"))
    got = h.filter("whole").groupBy("block", "part").applyInArrow(look_up, f"query_id string, whole boolean, candidates {CANDIDATES}")
    more = h.filter("not whole").groupBy("block", "part").applyInArrow(look_up, f"query_id string, whole boolean, candidates {CANDIDATES}")
    more = more.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("candidates"))).alias("candidates"))
    return got.select("query_id", "candidates").unionByName(more)
