"""Registered queries with their SQL on the smallest tables, and what their contracts fix of the others."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
QUERIES = registered.llm.queries()
SQL = registered.llm.oracle_sql()
COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "vec_id n_links component_id kept",
    "op3": "doc_id n_bytes n_tokens over_limit",
    "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id n_words n_removed kept_sha256",
    "op9": "doc_id fingerprint component_id",
    "op10": "doc_id held_out lang_pred score",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id start n_tokens ids_crc32",
    "op13": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_are_registered():
    assert QUERIES.keys() <= registered.queries().keys() and SQL.keys() <= QUERIES.keys()
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([*COLUMNS, "pipeline"])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name != "pipeline":
        table = "embeddings" if name.startswith("op2") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    if name in SQL:
        connection = duckdb.connect()
        for path in Path(SF_DIR).glob("*.parquet"):
            connection.execute(f"create view {path.stem} as select * from '{path}'")
        result = connection.execute(SQL[name])
        names = [c[0] for c in result.description]
        columns = sorted(df.columns)
        assert sorted(names) == columns
        expected = sorted(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
        assert sorted(tuple(row[c] for c in columns) for row in rows) == expected
