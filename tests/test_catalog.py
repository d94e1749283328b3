"""Every query that has SQL against DuckDB, and the others for running and for their columns."""

from __future__ import annotations

import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from weft.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    want = told.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(want, names)


def test_pivot_join_takes_every_source(spark, tmp_path):
    rows = [(2 * i + j, "the same line", "en", s, 13) for i, s in enumerate([None, *(f"src{n}" for n in range(20))]) for j in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    one = lambda s: hashlib.md5((s or "").encode()).hexdigest() < "8"
    first = max(i for i, _, _, s, _ in rows if one(s))
    want = {(str(first * 100000), str(i * 100000)) for i, _, _, s, _ in rows if not one(s)}
    assert {tuple(r) for r in QUERIES["pivot_join_all"](spark, str(tmp_path)).select("src_text", "tgt_text").collect()} == want
