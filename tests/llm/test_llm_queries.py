import os

import pytest
from oracle import connect, differs
from reelgrain.llm.queries import oracle_sql, queries

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["segment_id"], "p2_found": ["video_id", "group_id"], "p3_found": ["field", "key_a", "key_b"], "p4_found": ["video_id"],
    "p5_found": ["field", "record_key", "detail_id"], "p6_found": ["video_id", "turn_no", "speaker", "segment_id"], "p9_found": ["doc_id", "line_no", "lang"],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in oracle_sql():
        assert differs(df, connect(FOLDER), oracle_sql()[name]) is None
    else:
        assert df.count() > 0
