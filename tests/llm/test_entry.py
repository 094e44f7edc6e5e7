"""Every query of the subpackage runs on the smallest tables and keeps the stated columns."""

import os

import pytest

from filingloom.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["stock_code_a", "stock_code_b"],
    "p2_found": ["config", "sample_id"],
    "p3_found": ["record_kind", "key_a", "key_b"],
    "p4_found": ["document_id", "page_number", "noise"],
    "p5_found": ["config", "sample_id", "defect"],
    "p6_found": ["document_id", "page_number", "line_no"],
    "p7_found": ["question_id_a", "question_id_b"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        assert df.count() > 0
