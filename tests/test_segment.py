"""Segmentation cases."""

import random

from filingloom.operators import segment as S


def test_block_stops_at_answer():
    t = "问题1.关于经营业绩。\n年报披露，公司收入下降。请公司：（1）说明原因及合理性；（2）列示主要客户情况。请年审会计师发表意见。\n回复：\n一、公司说明\n内容"
    blocks = S.parent_blocks(t)
    assert len(blocks) == 1
    assert "回复" not in blocks[0][4] and "内容" not in blocks[0][4]
    assert blocks[0][3] == "关于经营业绩"
    assert len(S.strict_children(blocks[0][4])) == 2


def test_children_numbered_in_order():
    got = S.children("公司收入下降。请公司：（1）说明收入原因；（2）列示客户明细；（3）分析毛利率。")
    assert [x[0] for x in got] == ["1", "2", "3"]
    assert got[0][1] == "说明收入原因"


def test_references_are_no_markers():
    got = S.children("请公司：（1）说明收入下降原因；（2）列示客户。请独立董事对问题（1）（2）发表意见。")
    assert len(got) == 2


def test_unlabelled_requests_split_only_if_all_are_requests():
    assert [x[2] for x in S.children("背景。请公司说明收入下降的主要原因；列示前五名客户名称及金额。")] == ["semicolon", "semicolon"]
    assert [x[2] for x in S.children("背景。请公司说明收入下降的主要原因；谢谢。")] == ["whole"]
    assert S.children("没有要求") == []


def test_professional_requests():
    rest, asked = S.without_professional("说明毛利率下降的原因。请年审会计师就上述问题进行核查并发表明确意见。（问询函第一条）")
    assert rest == "说明毛利率下降的原因"
    assert "请年审会计师" in asked and "问询函第一条" in asked
    assert S.without_professional("说明原因。") == ("说明原因。", "")


def test_merge_spans_against_points():
    rnd = random.Random(1)
    for _ in range(50):
        spans = [(a, a + rnd.randint(1, 6), str(i)) for i, a in enumerate(rnd.sample(range(40), 8))]
        covered = {p for a, b, _ in spans for p in range(a, b)}
        merged = S.merge_spans(spans)
        assert {p for a, b, _ in merged for p in range(a, b)} == covered
        assert all(x[1] <= y[0] for x, y in zip(merged, merged[1:], strict=False))


def test_explode_rows_with_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "请公司：（1）说明收入原因；（2）列示客户明细。")], "id string, t string")
    assert [(r["id"], r["ord"], r["label"]) for r in S.derived_children(df, ["id"], "t").orderBy("id", "ord").collect()] == [("c", 1, "1"), ("c", 2, "2")]


def test_merged_intervals_and_headings(spark):
    df = spark.createDataFrame([("u", 0, 5), ("u", 3, 8), ("u", 8, 9), ("v", 1, 2)], "k string, a int, b int")
    assert sorted((r["k"], r["start"], r["stop"], r["parts"]) for r in S.merged_intervals(df, ["k"], "a", "b").collect()) == [("u", 0, 8, 2), ("u", 8, 9, 1), ("v", 1, 2, 1)]
    h = spark.createDataFrame([("d", 1, "A"), ("d", 2, None), ("d", 3, "B"), ("e", 1, None)], "d string, n int, h string")
    assert [r["section"] for r in S.heading_as_of(h, ["d"], ["n"], "h").orderBy("d", "n").collect()] == ["A", "A", "B", None]
