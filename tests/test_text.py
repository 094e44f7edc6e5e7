"""Text scalars against their stated meaning."""

import re

import pytest
from pyspark.sql import functions as F

from filingloom.functions import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr).collect()]


def test_clean_page_text(spark):
    got = one(spark, T.clean_page_text("x"), "公司 名称 ，　ok\n\n  第二 行  \n（ 一", "a​b c", "", None)
    assert got == ["公司名称， ok\n第二行\n（一", "ab c", "", None]


def test_page_status(spark):
    assert one(spark, T.page_status("x"), "封面", "长" * 40, "　" * 50, None) == ["needs_ocr", "success", "needs_ocr", "needs_ocr"]


def test_report_text_joins_lines(spark):
    assert one(spark, T.report_text("x"), "收入 \n 下降 原因", "ab\ncd", " x ") == ["收入下降原因", "abcd", "x"]


def test_compact(spark):
    t = "本公司董事会及全体董事保证真实\n承担法律责任。请公司\n- 12 -\n第 3 页 共 9 页\n证券代码：600000\n说明 原因；"
    assert one(spark, T.compact("x"), t) == ["请公司说明原因"]


def test_answer_text(spark):
    got = one(spark, T.answer_text("x"), "<think>甲</think>**监管问询子问题**：请说明，原因　。", "a b")
    assert got == ["请说明,原因.", "ab"]


@pytest.mark.parametrize(("text", "number"), [("3", 3), ("十", 10), ("十二", 12), ("三十", 30), ("四十五", 45), ("甲", None)])
def test_numeral(spark, text, number):
    assert one(spark, T.numeral("x"), text) == [number]


def test_question_number(spark):
    df = spark.createDataFrame([("问题 二、关于存货", "a_q07", 9), ("没有", "a_q07_sub01", 9), ("没有", "zz", 9)], "t string, k string, f int")
    assert [r[0] for r in df.select(T.question_number("t", "k", "f")).collect()] == [2, 7, 9]


def test_strip_requester(spark):
    assert one(spark, T.strip_requester("x"), "请公司：说明原因。", "请补充披露明细；", "请示") == ["说明原因", "补充披露明细", "请示"]


def test_query_keeps_background(spark):
    df = spark.createDataFrame([("关于存货", "存货大增。请公司说明原因", "说明存货")], "t string, p string, q string")
    assert df.select(T.retrieval_query("t", "p", "q")).first()[0] == "关于存货。存货大增。。说明存货"


def test_page_range_and_topic(spark):
    df = spark.createDataFrame([(3, 3), (3, 4), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(T.page_range("a", "b")).collect()] == ["p3", "p3-4", None]
    assert one(spark, T.topic_title(F.lit(""), "x"), "3.关于存货。其他", "无") == ["关于存货", None]


def brute_tokens(t):
    t = re.sub(r"(?<=[一-鿿])\s+(?=[一-鿿])", "", re.sub(r"\s*\n\s*", "", t)).lower()
    out = []
    for run in re.findall(r"[一-鿿]+", t):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    for m in re.findall(r"[a-z0-9]+(?:[.,][a-z0-9]+)*%?", t):
        m = m.replace(",", "")
        out.append(m)
        if m.endswith("%"):
            out.append(m[:-1])
    return sorted(out)


def test_tokens_against_brute_force(spark):
    texts = ["存货跌价准备", "a中b文c", "增长12.5%，1,234万元", "", "中", "ABC-def 收入2024年"]
    assert [sorted(x) for x in one(spark, T.tokens("x"), *texts)] == [brute_tokens(t) for t in texts]
