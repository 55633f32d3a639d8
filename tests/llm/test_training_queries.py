import oracle
import pytest

from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    oracle.same(QUERIES[name](spark, data), oracle.connect(data), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_and_found_is_distinct(spark, data, name):
    df = QUERIES[name](spark, data)
    n = df.count()
    if name.endswith("_found"):
        assert n == df.distinct().count()


def test_found_columns(spark, data):
    want = {
        "p1_found": "directory:string,file_path:string", "p2_found": "item_kind:string,item_id:string", "p3_found": "id_a:string,id_b:string", "p4_found": "term:string,mark:string",
        "p5_found": "file_id:bigint", "p6_found": "doc_id:bigint,item_id:bigint", "p8_found": "doc_id:bigint",
    }
    for name, cols in want.items():
        assert ",".join(f"{c}:{t}" for c, t in QUERIES[name](spark, data).dtypes) == cols
