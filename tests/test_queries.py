import os

import pytest
from oracle import connect, differs
from reelgrain.plans import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_every_query_against_its_sql(spark):
    con, sql = connect(FOLDER), registry.oracle_sql()
    wrong = {}
    for name, query in registry.queries().items():
        df = query(spark, FOLDER)
        if name in sql:
            if found := differs(df, con, sql[name]):
                wrong[name] = found
        else:
            df.count()
    assert not wrong


def test_entry_without_optional_parts(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
