"""Chunks and BM25 against plain Python."""

import math
from collections import Counter

import pytest

from filingloom.operators import retrieve
from test_text import brute_tokens

PAGE = "stock_code string, report_year string, document_id string, document_type string, page_number int, text string"


def brute_chunks(texts, size, overlap, least):
    whole = "\n".join(t for t in texts if t)
    out, start, step = [], 0, size - overlap
    while True:
        piece = whole[start : start + size].strip()
        if len(piece) >= least:
            out.append(piece)
        if start + size >= len(whole):
            return out
        start += step


@pytest.mark.parametrize("sizes", [[750], [751], [1400], [1401], [100, 700, 30, 900], [10], [750, 1], [1300, 1300, 1], [20] * 60])
def test_chunks_against_brute_force(spark, sizes):
    texts = ["".join(chr(0x4E00 + (i * 7 + j) % 5000) for j in range(n)) for i, n in enumerate(sizes)]
    rows = [("600000", "2024", "d", "annual_report", i + 1, t) for i, t in enumerate(texts)] + [("600000", "2024", "d", "annual_report", 1, texts[0]), ("600000", "2024", "r", "reply", 1, "答" * 900), ("600000", "2024", "d", "annual_report", 99, None)]
    got = retrieve.report_chunks(spark.createDataFrame(rows, PAGE)).orderBy("chunk_no").collect()
    assert [r["text"] for r in got] == brute_chunks(texts, 750, 100, 50)
    assert [r["chunk_no"] for r in got] == list(range(1, len(got) + 1))
    if got:
        assert got[0]["page_start"] == 1


def brute_bm25(docs, query, k):
    toks = {d: Counter(brute_tokens(t)) for d, t in docs.items()}
    q = Counter(brute_tokens(query))
    if not docs or not q:
        return []
    n, avg = len(docs), (sum(sum(c.values()) for c in toks.values()) / len(docs)) or 1
    df = Counter(t for c in toks.values() for t in c)
    s = {}
    for d, c in toks.items():
        dl = sum(c.values()) or 1
        s[d] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / avg)) * (1 + math.log(f)) for t, f in q.items() if c[t])
    return sorted(((round(v, 9), d) for d, v in s.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_bm25_against_brute_force(spark):
    docs = {"a": {"d1": "货币资金 利息收入 受限资金", "d2": "存货 跌价准备 可变现净值", "d3": "", "d4": "存货 跌价准备 可变现净值"}, "b": {"e1": "存货跌价"}}
    queries = [("a", "q1", "存货跌价准备是否充分 存货"), ("a", "q2", "利息"), ("b", "q3", "存货"), ("b", "q4", ""), ("c", "q5", "存货")]
    d = spark.createDataFrame([(p, i, t) for p, x in docs.items() for i, t in x.items()], "p string, doc_id string, text string")
    q = spark.createDataFrame(queries, "p string, query_id string, text string")
    got = {}
    for r in retrieve.bm25(d, q, ["p"], 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
    for p, name, text in queries:
        want = brute_bm25(docs.get(p, {}), text, 3)
        assert [x[1] for x in got.get(name, [])] == [x[1] for x in want]
        assert [x[0] for x in got.get(name, [])] == pytest.approx([x[0] for x in want], abs=1e-8)


def test_bm25_global_and_recall(spark):
    d = spark.createDataFrame([("x", "存货 商誉"), ("y", "商誉")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "存货")], "query_id string, text string")
    assert [r["doc_id"] for r in retrieve.bm25(d, q, [], 2).orderBy("rank").collect()] == ["x", "y"]
    hits = spark.createDataFrame([("g1", 2), ("g1", 5), ("g2", 7)], "gold_id string, rank int")
    gold = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g3",)], "gold_id string")
    assert {r["k"]: round(r["recall"], 4) for r in retrieve.recall_at(hits, gold).collect()} == {1: 0.0, 3: 0.3333, 5: 0.3333, 10: 0.6667}
    assert {r["recall"] for r in retrieve.recall_at(hits, gold.limit(0)).collect()} == {0.0}


def test_ranges_meet(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10, 12, 12, 15), (10, 12, 8, 10), (10, 12, 13, 15), (None, 12, 10, 12)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(retrieve.ranges_meet(*map(F.col, "abcd"))).collect()] == [True, True, False, False]
