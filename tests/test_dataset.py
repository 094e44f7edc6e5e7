"""Quality, dataset, evaluation, sources and streaming."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filingloom.functions import text as T
from filingloom.operators import dataset, evaluate, quality, retrieve
from filingloom.session import materialize, widen
from filingloom.sources import io
from filingloom.streaming import pages as streaming

Q = "question_id string, source_file string, question_text string, question_level string, source_page_start int, source_page_end int, needs_review boolean"


def test_all_nine_issues(spark):
    rows = [
        ("e", "f1", "", "subquestion", 1, 1, False),
        ("e2", "f2", None, "subquestion", 1, 1, False),
        ("d", "f1", "请解释收入下降的原因", "subquestion", None, 1, True),
        ("d", "f2", "请解释 收入下降的原因", "subquestion", 1, 1, None),
        ("p", "f1", "短", "parent", 1, 1, False),
        ("c", "f1", "经核查，收入真实合理完整", "subquestion", 1, 1, False),
    ]
    got = {(r[0], r[2]) for r in quality.question_issues(spark.createDataFrame(rows, Q)).select("question_id", "source_file", "issue_type").collect()}
    assert ("e", "empty_question") in got and ("e", "same_question_from_multiple_files") in got and ("e", "duplicate_question_text") not in got
    assert {i for k, i in got if k == "d"} == {"duplicate_question_id", "duplicate_question_text", "same_question_from_multiple_files", "missing_source_page", "source_needs_manual_review"}
    assert ("p", "abnormal_parent_length") in got and ("c", "possible_response_contamination") in got and ("e", "abnormal_subquestion_length") in got
    assert quality.question_issues(spark.createDataFrame([], Q)).count() == 0


def test_parse_status(spark):
    rows = [("a", 1, "failed"), ("a", 2, "failed"), ("b", 1, "needs_ocr"), ("c", 1, "success"), ("c", 2, "failed"), ("d", 1, "success"), ("d", 1, "success")]
    got = {r[0]: (r[1], r[2]) for r in quality.parse_status(spark.createDataFrame(rows, "document_id string, page_number int, extraction_status string")).collect()}
    assert got == {"a": (2, "failed"), "b": (1, "needs_ocr"), "c": (2, "partial_needs_ocr"), "d": (1, "success")}


def test_sources_are_routed(spark):
    rows = [("1", "inquiry", "", "a", False, "success"), ("1", "reply", "", "b", False, "success"), ("2", "supporting", "y", "c", False, "success"), ("2", "supporting", "x", "d", False, "success"), ("3", "reply", "", "e", True, "success"), ("4", "reply", "", "f", False, "failed")]
    f = spark.createDataFrame(rows, "stock_code string, document_type string, supporting_subtype string, relative_path string, is_missing boolean, parse_status string")
    got = dataset.routed_sources(f, {"inquiry": 0, "reply": 1, "supporting": 2})
    assert sorted(r["relative_path"] for r in got.collect()) == ["a", "c"]  # subtypes outside of the map are equal; the path decides


@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 20, 21, 40])
def test_gold_windows_against_brute_force(spark, n):
    rnd = random.Random(n)
    gold = "".join(rnd.choice("甲乙丙丁戊") for _ in range(n))
    inputs = {"i1": "前" + gold[3:] + "后" * 20, "i2": "x" * 30, "i3": gold, "i4": None}
    starts = range(0, max(1, len(gold) - 15), 5)
    want = {i for i, t in inputs.items() if t and gold and any(gold[s : s + 15] in t for s in starts)}
    g = spark.createDataFrame([("g", gold)], "gold_id string, text string")
    got = {r["input_id"] for r in dataset.gold_windows(g, spark.createDataFrame(list(inputs.items()), "input_id string, text string")).collect()}
    assert got == want


def test_splits_labels_and_padding(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "stock_code string, n int")
    given = spark.createDataFrame([("a", "train"), ("b", "test")], "stock_code string, split string")
    placed, missing = dataset.entity_splits(rows, given, strict=False), dataset.unassigned(rows, given)
    assert placed.count() == 2 and [r[0] for r in missing.collect()] == ["c"]
    assert dataset.split_overlaps(placed.union(spark.createDataFrame([("a", 1, "test")], placed.schema)), "stock_code").count() == 1
    x = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, a array<int>")
    ids, labels = dataset.masked_labels(F.col("p"), F.col("a"), 4)
    assert x.select(ids, labels).first()[:] == ([2, 3, 4, 5], [-100, -100, 4, 5])
    assert x.select(dataset.padded(F.col("a"), F.lit(4), 0)).first()[0] == [4, 5, 0, 0]


def test_evidence_and_messages(spark):
    hits = spark.createDataFrame([("q", 2, "d2"), ("q", 1, "d1"), ("q", 9, "d3")], "query_id string, rank int, doc_id string")
    docs = spark.createDataFrame([("d1", 1, 1, "甲"), ("d2", 2, 3, "乙"), ("d3", 1, 1, "丙")], "doc_id string, page_start int, page_end int, text string")
    q = spark.createDataFrame([("q",)], "query_id string")
    rows = retrieve.candidate_rows(q, hits.withColumn("score", F.lit(1.0)), docs).select(dataset.evidence_block(F.col("candidates"), 2))
    assert rows.first()[0] == "【证据1｜年报页 p1｜chunk d1】\n甲\n【证据2｜年报页 p2-3｜chunk d2】\n乙"
    m = spark.range(1).select(dataset.chat_messages(F.lit("s"), F.lit("u"), F.lit("a")).alias("m")).first()["m"]
    assert [(x["role"], x["content"]) for x in m] == [("system", "s"), ("user", "u"), ("assistant", "a")]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("甲乙丙x") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        assert evaluate.common_length(a, b) == slow_lcs(a, b)


def test_rouge_and_points(spark):
    df = spark.createDataFrame([("请说明存货", "请说明存货"), ("", "x"), (None, "x"), ("ab", "cd")], "p string, r string")
    assert [r[0] for r in df.select(evaluate.rouge_l(F.col("p"), F.col("r"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    t = spark.createDataFrame([("请补充披露2023年存货的合理性，是否存在跌价", "甲公司")], "t string, c string")
    points = t.select(evaluate.key_points(T.answer_text("t"), F.col("c"))).first()[0]
    assert "action:补充披露" in points and "action:披露" not in points and "fin_item:存货" in points and "time_scope:2023" in points
    both = spark.createDataFrame([([], []), (["a:x"], []), (["a:xy", "b:q"], ["a:x", "b:z"])], "p array<string>, r array<string>")
    assert [tuple(r[2:]) for r in evaluate.prf(both, "p", "r").collect()] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    e = spark.createDataFrame([("action:说明", "x", True), ("fin_item:存货", "存货大增", True), ("risk_or_disclosure:是否减值", "没有", True)], "p string, e string, z boolean")
    assert [r[0] for r in e.select(evaluate.supported(F.col("p"), F.col("e"))).collect()] == [None, True, False]
    u = spark.createDataFrame([("2023年10万元和2024年", "10万元", 2024)], "t string, c string, y int")
    assert u.select(evaluate.unfounded(F.col("t"), F.col("c"), F.col("y"), F.lit("甲"), F.array().cast("array<string>"))).first()[0] == ["year:2023"]


def test_manifest_paths(spark):
    rows = [("raw/600000_甲_乙/annual_report/x2023年.pdf",), ("raw/600000_甲/supporting/note/天职业字202533298号.pdf",), ("raw/600000_甲/inquiry/MISSING.txt",), ("raw/600000_甲/file.pdf",)]
    got = [(r["stock_code"], r["company"], r["document_type"], r["supporting_subtype"], r["report_year"]) for r in io.manifest(spark.createDataFrame(rows, "relative_path string")).collect()]
    assert got == [("600000", "甲_乙", "annual_report", "", "2023"), ("600000", "甲", "supporting", "note", "2025"), ("600000", "甲", "missing_notice", "", "2024"), ("600000", "甲", "unknown", "", "2024")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1), (None, 2)], "a string, b int")
    io.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(io.read_jsonl(spark, f"{tmp_path}/j", df.schema).collect(), key=lambda r: r["b"]) == df.orderBy("b").collect()
    io.write_csv(df, f"{tmp_path}/c", ["b", "a", "zz"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["b", "a", "zz"]
    assert io.copy_once(df, f"{tmp_path}/p").count() == 2
    assert io.copy_once(df.limit(0), f"{tmp_path}/p").count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.txt").write_text("一\f二")
    (tmp_path / "raw/b.txt").write_bytes(b"\xff\xfe\xff")
    files = io.scan(spark, f"{tmp_path}/raw", content=True)
    ok, bad = io.extract_pages(files, lambda b: b.decode("utf-8").split("\f"))
    assert sorted((r["page_number"], r["text"]) for r in ok.collect()) == [(1, "一"), (2, "二")] and bad.filter("failure_type != 'needs_ocr'").count() == 1
    assert [r["score"] for r in io.score_batches(df, lambda xs: [len(x or "") for x in xs], "a", "int").orderBy("b").collect()] == [1, 0]
    assert materialize(df).count() == 2 and isinstance(widen(df, "z int"), StructType)


def test_stream_drops_redelivery(spark, tmp_path):
    schema = "document_id string, page_number int, text string, extraction_status string, loaded_at timestamp"
    rows = [("d", 1, "封面", "x", "2024-01-01 00:00:00"), ("d", 1, "封面", "x", "2024-01-01 05:00:00"), ("d", 2, "长" * 50, "x", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "document_id string, page_number int, text string, extraction_status string, l string").withColumn("loaded_at", F.to_timestamp("l")).drop("l").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = streaming.arriving_pages(stream).writeStream.format("memory").queryName("pages_once").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["page_number"], r["extraction_status"]) for r in spark.table("pages_once").collect()) == [(1, "needs_ocr"), (2, "success")]
