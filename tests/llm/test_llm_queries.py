import pytest

from loomgraph.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, rows

COLUMNS = {
    "p4_found": {"doc_id": "bigint"},
    "p5_found": {"doc_id": "bigint"},
    "p6_found": {"src": "string", "rec_id": "string", "line_no": "int"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "subject": "string"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    got = df.toPandas()
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in ORACLES:
        want = connect(sf_dir).execute(ORACLES[name]).df()
        assert rows(got) == rows(want)
