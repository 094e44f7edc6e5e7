"""Retrieval over stored blocks: against plain Python, and what it writes."""

import os
import random

import pytest

from filingloom.functions import text as T
from filingloom.operators import blocks, retrieve
from filingloom.plans import queries as core
from test_retrieve import PAGE, brute_bm25

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", ["candidate_counts", "evidence_text", "evidence_support", "page_range_hits", "gold_recall", "recall_at_k", "unfounded_facts"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_shuffles_follow_the_input(spark, name):
    before = shuffled(spark)
    core.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    written = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert 0 < written < 5 * sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("page_records", "question_records"))


def test_terms_as_tokens(spark):
    texts = ["存货跌价准备", "a中b文c", "增长12.5%，1,234万元 12.5%", "", "中", "ABC-def 收入2024年\n 存　货 跌 价", "İK 3%a,b", "中\n文\n"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.tokens("x")).collect()]
    code = lambda t: ord(t) if len(t) == 1 and t >= "一" else ord(t[0]) << 21 | ord(t[1]) if t[0] >= "一" else blocks.latin_code(t)
    codes, of = blocks.term_codes(texts)
    assert [sorted(codes[of == i].tolist()) for i in range(len(texts))] == [sorted(map(code, r)) for r in rows]


@pytest.mark.parametrize("size", [10**6, 4000])
def test_hits_against_brute_force(spark, size):
    """Also with a report in several blocks, repeated chunks (ties), a query without terms, one without a report, and null keys."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("存货跌价准备商誉收入现金a1 ") for _ in range(n))
    same = word(700)
    rows = [(code, "2024", f"d{code}", "annual_report", i + 1, same if i % 5 == 1 else word(rnd.choice([30, 700, 900]))) for code, n in (("a", 25), ("b", 3), (None, 4)) for i in range(n)]
    stored = retrieve.stored_chunks(spark.createDataFrame(rows, PAGE), block=size)
    assert (stored.rows.filter("report = 'a/2024'").select("block").distinct().count() > 2) == (size == 4000)
    ask = [(r, f"q{r}{i}", word(12)) for r in ("a/2024", "b/2024", "/2024", "c/2024") for i in range(5)] + [("a/2024", "none", "，。"), ("a/2024", "far", "鿿鿾")]
    hits = blocks.report_hits(stored, spark.createDataFrame(ask, "report string, query_id string, text string"), 4)
    got, docs = {}, {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
    chunks = core._docs(stored).collect()
    for r in chunks:
        docs.setdefault(r["report"], {})[r["doc_id"]] = r["text"]
    for report, name, text in ask:
        want = brute_bm25(docs.get(report, {}), text, 4)
        assert [x[1] for x in got.get(name, [])] == [x[1] for x in want]
        assert [x[0] for x in got.get(name, [])] == pytest.approx([x[0] for x in want], abs=1e-8)
    text_of = {r["doc_id"]: r["text"] for r in chunks}
    for r in blocks.with_texts(hits, stored).collect():
        assert [(c["doc_id"], c["text"]) for c in r["candidates"]] == [(d, text_of[d]) for _, d in got.pop(r["query_id"])]
    assert not got


def test_numbers_skip_dropped_windows(spark):
    """A window that holds next to nothing is no chunk, and later ones move up."""
    texts = ["甲" * 700 + "x" + "\u2003" * 1500 + "x" + "乙" * 900, "丙" * 300]
    rows = [("600000", "2024", "d", "annual_report", i + 1, t) for i, t in enumerate(texts)]
    stored = retrieve.stored_chunks(spark.createDataFrame(rows, PAGE))
    assert stored.shifted.count() > 0
    got = [r["chunk_no"] for r in blocks.numbered(stored.rows, stored).orderBy("w").collect()]
    assert got == list(range(1, len(got) + 1))
