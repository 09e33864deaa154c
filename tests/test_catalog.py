"""Every query that SQL can say, against DuckDB over the same files; the others run and give rows."""

import duckdb
import pytest

from fadeline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows, columns):
    out = []
    for r in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) else bool(v) if isinstance(v, bool) else v for v in (r[columns.index(c)] for c in sorted(columns))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == comparable(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if "recall" in df.columns:
        assert rows[0]["recall"] >= 0.9
    if name == "ann_integrity":
        assert rows[0]["dangling"] == rows[0]["loops"] == rows[0]["repeats"] == rows[0]["over_degree"] == 0


@pytest.mark.parametrize("name", ["incremental_topk_by_checkpoint", "incremental_topk_replay"])
@pytest.mark.parametrize("n", [0, 1, 19, 33, 271])
def test_checkpoints_of_any_number_of_rows(spark, tmp_path, name, n):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {n}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert got == comparable(want.fetchall(), want.columns)
    assert (got != []) == (n > 1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
