import pytest

from lumenq.llm import queries as llm
from tests.twins import compare

COLUMNS = {
    "p1_found": ["index_name", "term_id", "mark"],
    "p3_found": ["source_table", "run_id", "field", "pct"],
    "p4_found": ["source_table", "id_a", "id_b"],
    "p5_found": ["id", "cell_ordinal"],
    "p6_found": ["record_id", "term_id"],
    "p7_found": ["query_id", "id"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["mix_id", "source"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_twin(spark, data, name):
    compare(spark, data, llm.QUERIES[name], llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_runs(spark, data, name):
    df = llm.QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)
    if name != "p3_found":
        assert rows
