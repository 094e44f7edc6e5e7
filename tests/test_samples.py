"""Samples, evidence, facts, sources and reports on literal cases."""

import pytest
from pyspark.sql import functions as F

from filingloom.functions import rules as R
from filingloom.functions import text as T
from filingloom.operators import dataset, evaluate, ordered, retrieve
from filingloom.sources import io, reports


def candidates(spark):
    q = spark.createDataFrame([("q1", "甲", "1", 2024, "请说明存货的情况"), ("q2", "乙", "2", 2024, "请说明商誉的情况"), ("q3", "丙", "3", 2024, " ")], "query_id string, company string, stock_code string, report_year int, question_text string")
    hits = spark.createDataFrame([("q1", 1, "1/2024#00001", 2.0), ("q1", 2, "1/2024#00002", 1.0), ("q3", 1, "1/2024#00001", 0.0)], "query_id string, rank int, doc_id string, score double")
    docs = spark.createDataFrame([("1/2024#00001", 3, 3, "存货余额一亿元 "), ("1/2024#00002", 3, 4, "跌价准备")], "doc_id string, page_start int, page_end int, text string")
    return retrieve.candidate_rows(q, hits, docs)


def test_questions_without_a_report_stay(spark):
    got = {r["query_id"]: r for r in candidates(spark).collect()}
    assert (got["q2"]["candidate_count"], got["q2"]["max_score"], got["q2"]["candidates"]) == (0, 0.0, [])
    assert got["q1"]["max_score"] == 2.0 and [c["rank"] for c in got["q1"]["candidates"]] == [1, 2]
    assert {r["query_id"] for r in retrieve.without_candidates(candidates(spark)).collect()} == {"q2", "q3"}
    assert {r["query_id"] for r in dataset.exportable(candidates(spark)).collect()} == {"q1"}


def test_gold_is_not_in_the_prompt(spark):
    s = {r["sample_id"]: r for r in dataset.chat_samples(candidates(spark), "系统", "公司：{company}\n{evidence}\n完", "公司：{company}\n无").collect()}
    assert s["q1"]["messages"][1]["content"] == "公司：甲\n【证据1｜年报页 p3｜chunk 1/2024#00001】\n存货余额一亿元\n【证据2｜年报页 p3-4｜chunk 1/2024#00002】\n跌价准备\n完"
    assert "请说明存货" not in s["q1"]["messages"][1]["content"] and s["q1"]["messages"][2]["content"] == "请说明存货的情况"
    assert s["q2"]["messages"][1]["content"] == "公司：乙\n无" and s["q2"]["metadata"]["evidence_top_k"] == 0
    m = s["q1"]["metadata"]
    assert (m["evidence_chunk_ids"], m["evidence_page_ranges"], m["evidence_companies"]) == (["1/2024#00001", "1/2024#00002"], ["p3", "p3-4"], ["1"])
    assert [r["sample_id"] for r in dataset.first_samples(dataset.chat_samples(candidates(spark), "", "{evidence}"), 2).collect()] == ["q1", "q2"]


def test_splits_raise(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, stock_code string")
    given = spark.createDataFrame([("1", "train"), ("2", "test")], "stock_code string, split string")
    assert {tuple(r) for r in dataset.entity_splits(rows, given).select("id", "split").collect()} == {("a", "train"), ("b", "test")}
    for bad in (given.filter("stock_code = '1'"), given.union(spark.createDataFrame([("1", "test")], given.schema))):
        with pytest.raises(Exception, match="split"):
            dataset.entity_splits(rows, bad).collect()
    assert dataset.entity_splits(rows, given.limit(1), strict=False).count() == 1
    assert [r[0] for r in dataset.unassigned(rows, given.filter("stock_code = '1'")).collect()] == ["2"]


def test_source_priority_follows_the_map(spark):
    cols = "document_id string, stock_code string, document_type string, supporting_subtype string, relative_path string, is_missing boolean, parse_status string"
    rows = [("a1", "1", "supporting", "", "a", False, "success"), ("a2", "1", "supporting", "auditor_reply", "z", False, "success"), ("a3", "1", "supporting", "independent_director", "b", False, "success")]
    rows += [("b1", "2", "supporting", "sponsor_or_broker", "z", False, "success"), ("b2", "2", "supporting", "independent_director", "a", False, "success"), ("b3", "2", "supporting", "other", "0", False, "success")]
    rows += [("c1", "3", "inquiry", None, "a", False, "success"), ("c2", "3", "inquiry", None, "b", False, "success"), ("c3", "3", "reply", None, "a", False, "success"), ("d1", "4", "inquiry", None, "a", True, "success"), ("d2", "4", "reply", None, "a", False, "failed"), ("e1", "5", "supporting", None, "a", False, "success"), ("e2", "5", "supporting", "x", "0", False, "success")]
    got = {r["document_id"] for r in dataset.routed_sources(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a2", "b1", "c1", "c2", "e1"}


def test_document_ids(spark):
    paths = ["02_raw_pdf/600001_甲/annual_report/600001_甲2023年年报.pdf", "02_raw_pdf/600001_甲/inquiry/x_MISSING.txt", "02_raw_pdf/600001_甲/supporting/auditor_reply/天职业字202533298号.pdf", "02_raw_pdf/600001_甲/other/a.pdf", "02_raw_pdf/600001_甲/a.pdf"]
    got = {r["relative_path"]: r for r in io.manifest(spark.createDataFrame([(p,) for p in paths], "relative_path string")).collect()}
    assert got[paths[0]]["document_id"].startswith("600001_2023_annual_report_") and len(got[paths[0]]["document_id"].split("_")[-1]) == 8
    assert got[paths[1]]["document_id"].startswith("600001_2024_missing_notice_inquiry_")
    assert got[paths[2]]["document_id"].startswith("600001_2025_supporting_auditor_reply_") and got[paths[2]]["supporting_subtype"] == "auditor_reply"
    assert got[paths[3]]["document_type"] == got[paths[4]]["document_type"] == "unknown"


def test_extraction_keeps_the_pages_that_work(spark):
    def extractor(content):
        if content == b"bad":
            raise ValueError("no file")
        yield "第一页的内容足够长，超过四十个字，因此这一页的抽取状态应当是成功，不需要再做任何识别工作。"
        yield ValueError("page")
        yield "短"

    files = spark.createDataFrame([("a.pdf", b"x"), ("b.PDF", b"bad"), ("c.txt", b"x")], "path string, content binary")
    pages, failures = io.extract_pages(files, extractor, ".pdf")
    assert {(r["path"], r["page_number"], r["extraction_status"]) for r in pages.collect()} == {("a.pdf", 1, "success"), ("a.pdf", 2, "failed"), ("a.pdf", 3, "needs_ocr")}
    assert {(r["path"], r["page_number"], r["failure_type"]) for r in failures.collect()} == {("a.pdf", 2, "page_failed"), ("a.pdf", 3, "needs_ocr"), ("b.PDF", None, "open_failed")}


def test_facts(spark):
    p = "说明甲乙股份有限公司2019年存货12.5万元的合理性,是否涉及丙丁集团"
    rows = spark.createDataFrame([("m", "s1", "1", "甲乙", 2024, p, None), ("m", "s2", "2", "甲乙", 2024, p, None), ("m", "s3", "1", "甲乙", 2019, "说明存货", "商誉")], "config string, sample_id string, stock_code string, company string, report_year int, p string, evidence string")
    rows = rows.withColumn("pred", evaluate.key_points(F.col("p"), F.col("company")))
    corpora = spark.createDataFrame([("1", "甲乙股份有限公司存货余额12.5万元,减值会计估计")], "stock_code string, corpus string").withColumn("known", evaluate.lexicon(F.col("corpus"), F.lit("")))
    out = {r["sample_id"]: r for r in evaluate.fact_rows(rows, corpora, ["stock_code"]).collect()}
    assert "fin_item:存货" in out["s1"]["supported"] and any(x.startswith("entity:") and "甲乙" in x for x in out["s1"]["supported"])
    assert any(x.startswith("entity:") and x.endswith("丙丁集团") for x in out["s1"]["unfounded"]) and "year:2019" in out["s1"]["unfounded"] and not any(x.startswith("amount") for x in out["s1"]["unfounded"])
    assert not out["s2"]["supported"] and any(x.startswith("amount:12.5万元") for x in out["s2"]["unfounded"])
    assert out["s3"]["unsupported"] == ["fin_item:存货"] and out["s3"]["unfounded"] == []
    rate = evaluate.fact_rates(evaluate.fact_rows(rows, corpora, ["stock_code"])).collect()[0]
    assert rate["samples"] == 3 and abs(rate["hallucination_rate"] - 2 / 3) < 1e-9 and rate["support_rate"] == rate["supported"] / rate["points"]
    none = evaluate.fact_rates(evaluate.fact_rows(rows.filter("sample_id = 's3'").withColumn("pred", F.array().cast("array<string>")), corpora, ["stock_code"])).collect()[0]
    assert none["support_rate"] is None


def test_consistency_checks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("x", 4)], "id string, place int")
    test = spark.createDataFrame([("a", 1), ("b", 4), ("c", 3)], "id string, place int")
    assert {tuple(r) for r in evaluate.id_differences(rows, test, "id").collect()} == {("x", "extra"), ("c", "missing"), ("b", "repeated")}
    assert {r["id"] for r in evaluate.order_differences(rows, test, "id", "place").collect()} == {"b"}
    p = spark.createDataFrame([("m", "g", "x"), ("m", "g", "y"), ("n", "g", "x"), ("n", "g", "x")], "config string, prompt string, prediction string")
    assert [r["config"] for r in evaluate.group_conflicts(p, "config", "prompt", "prediction").collect()] == ["m"]
    table = evaluate.result_table(spark.createDataFrame([("a", 0.12346)], "config string, rouge_l double"), {"甲": "a", "乙": "b"}, ["rouge_l"], ["f1"])
    assert [tuple(r) for r in table.orderBy("place").collect()] == [(1, "甲", "0.1235", R.PENDING), (2, "乙", R.PENDING, R.PENDING)]
    assert reports.markdown(table.orderBy("place").select("place", "label")) == "| place | label |\n| ---: | --- |\n| 1 | 甲 |\n| 2 | 乙 |"
    with pytest.raises(ValueError):
        reports.markdown(table, most=1)


def test_reports(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('{"rank": 16}', encoding="utf-8")
    assert reports.read_config(str(tmp_path / "c.yaml")) == {"rank": 16}
    log = spark.createDataFrame([(1, None, 2.0, None), (None, 1.0, None, 3.0), (2, 1.0, None, None)], "step int, epoch double, loss double, eval_loss double")
    assert {tuple(r) for r in reports.log_series(log).collect()} == {("train", 1.0, 2.0), ("eval", 1.0, 3.0)}
    assert {r["name"] for r in reports.run_record(spark, 7, note="x").collect()} >= {"seed", "spark", "note"}


def test_batches_are_padded_to_their_longest(spark):
    rows = spark.createDataFrame([(f"s{i}", list(range(1, i + 2)), [-100] * i + [1]) for i in range(5)], "sample_id string, ids array<int>, labels array<int>")
    got = {r["sample_id"]: r for r in dataset.collated(rows, 2).collect()}
    assert [len(got[f"s{i}"]["ids"]) for i in range(5)] == [2, 2, 4, 4, 5] and got["s2"]["mask"] == [1, 1, 1, 0] and got["s2"]["labels"] == [-100, -100, 1, -100]
    assert dataset.accumulation(16, 4) == 4 and dataset.accumulation(2, 4) == 1


def test_running_sums_in_blocks(spark):
    rows = [(None if i % 7 == 0 else "k", i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r["k"], r["i"]): (r["s"], r["t"]) for r in ordered.running_sum(df, ["k"], F.floor(F.col("i") / 30), ["i"], F.col("v"), "s", "t").collect()}
    for k, i, _ in rows:
        own = [v for a, j, v in rows if a == k and j < i]
        assert got[k, i] == (sum(own), sum(v for a, _, v in rows if a == k))


def test_gold_rows(spark):
    t = spark.createDataFrame([("x_Q12", 1, 2), ("x_Q3", None, 2), ("x", 1, 2)], "sample_id string, a int, b int")
    assert [(r["sample_id"], r["question_number"]) for r in retrieve.gold_rows(t, "sample_id", "a", "b").collect()] == [("x_Q12", 12)]


def test_ranges_inside_pages(spark):
    spans = spark.createDataFrame([("d", 1, 10, 20), ("d", 2, 30, 40)], "k string, page int, from_ int, to_ int")
    r = spark.createDataFrame([("d", 20, 30), ("d", 15, 16), ("d", 22, 25), ("e", 1, 2)], "k string, start int, stop int")
    got = {(x["k"], x["start"]): (x["page_start"], x["page_end"]) for x in retrieve.span_pages(r, spans, ["k"]).collect()}
    assert got == {("d", 20): (1, 2), ("d", 15): (1, 1), ("d", 22): (2, 2), ("e", 1): (None, None)}


def test_short_gold_texts_are_compared_whole(spark):
    g = spark.createDataFrame([("g1", "存货跌价"), ("g2", ""), ("g3", None)], "gold_id string, text string")
    i = spark.createDataFrame([("i1", "说明存货跌价准备"), ("i2", "存货"), ("i3", None)], "input_id string, text string")
    assert [tuple(r) for r in dataset.gold_windows(g, i).collect()] == [("g1", "i1")]


def test_templates(spark):
    df = spark.createDataFrame([("甲", None)], "a string, b int")
    assert df.select(T.fill("{a}-{b}-{a}", a=F.col("a"), b=F.col("b"))).first()[0] == "甲--甲"


def test_pairs_are_scored_by_an_injected_model(spark):
    df = spark.createDataFrame([("甲乙", "甲"), (None, "甲")], "p string, r string")
    got = io.score_pairs(df, lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b, strict=True)], "p", "r").collect()
    assert sorted(r["score"] for r in got) == [-1.0, 1.0]


def test_rules_on_literal_cases():
    import re

    hit = lambda rule, text: [m[0] for m in re.finditer("(?m)" + rule, text)]
    assert hit(R.REQUEST_TRIGGER, "请公司说明。请你公司：列示。请年审会计师核查。请结合") == ["请公司", "请你公司", "请结合"]
    assert hit(R.STAGE_ONE_TRIGGER, "请年审会计师核查。请独立董事") == ["请年审会计师", "请独立董事"]
    assert hit(R.CHILD_MARKER, "（1）甲(二)乙（ 10 ）丙（甲）") == ["（1）", "(二)", "（ 10 ）"]
    assert hit(R.REFERENCE_MARKER, "对问题（1）（2）发表") == ["问题（1）（2）"]
    assert all(hit(R.OMISSION, x) for x in ("说明……", "略。", "（略）", "待补充", "a...", "____", "内容缺失")) and not hit(R.OMISSION, "战略合作、简略说明，攻略")
    assert hit(R.PARENT_START, "问题1.关于经营业绩。年报\n二、关于存货的问题\n3.年报披露，收入\n4.其他") == ["问题1.关于经营业绩。", "二、关于存货的问题", "3.年报披露，收入"]
    assert [bool(hit(R.ANSWER_LINE, x)) for x in ("回复：", "【公司回复】", "一、公司说明", "（一）公司回复", "会计师回复:", "公司的回复是")] == [True] * 5 + [False]
    assert hit(R.PROFESSIONAL[0], "请年审会计师就上述问题进行核查并发表明确意见。然后") == ["请年审会计师就上述问题进行核查并发表明确意见。"]
    assert hit(R.PROFESSIONAL[3], "原因（问询函第一条）") == ["（问询函第一条）"]
    assert hit(R.AMOUNT, "收入1,234.5万元，增长12%，减少3个百分点") == ["1,234.5万元", "12%", "3个百分点"]
    assert hit(R.WHETHER, "说明是否存在减值迹象，是否a") == ["是否存在减值迹象"]
    assert len(R.FULL_WIDTH) == len(R.HALF_WIDTH) == 28
