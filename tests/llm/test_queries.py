"""All registered queries of the subpackage: empty tables, and SQL where there is some."""

import pytest

from granary.llm import queries
from tests.llm.helpers import DOC


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, name, tmp_path):
    for table, kind in {"documents": DOC, "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    out = queries.queries()[name](spark, str(tmp_path)).collect()
    assert len(out) == (1 if name == "op8_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
