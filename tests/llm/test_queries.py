"""Every pN query on the smallest tables, those with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from folioframe.llm import queries

SF = os.environ.get("FOLIO_TEST_SF", "/root/testdata/sf0.001")
COLUMNS = {"p1_found": ["block_index", "item_id", "item_kind"], "p2_found": ["item_id", "item_kind"], "p4_found": ["end_char", "item_id", "item_table", "start_char"], "p5_found": ["name_a", "name_b", "project_id"], "p6_found": ["block_index", "chapter_id"], "p7_found": ["block_index", "item_id", "item_kind"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name]
        if name != "p8_ids":
            assert len(rows) == len(set(rows))
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
        assert sorted(str([norm(r[c]) for c in sorted(names)]) for r in rows) == sorted(str([norm(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
