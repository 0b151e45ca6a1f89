import pytest

from gridloom.queries import ORACLE_SQL, QUERIES
from oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, name):
    check(spark, data, QUERIES[name], ORACLE_SQL[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_sample_keeps_quotas(spark, data):
    rows = QUERIES["sampled_parks"](spark, data).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    again = QUERIES["sampled_parks"](spark, data).collect()
    assert sorted(rows) == sorted(again)


def test_gap_outcomes_cover_every_place(spark, data):
    from gridloom.views import source

    rows = QUERIES["gap_outcomes"](spark, data).collect()
    assert sorted(r["position"] for r in rows) == sorted(r["position"] for r in source(spark, data).collect())


def test_gap_analysis_counts_the_first_valid_row_of_an_id(spark):
    from gridloom.plans.ingest import gap_analysis

    at = (38.01, 27.01)
    rows = [("r", "a", "shop", *at, 1), ("r", "a", "park", *at, 2), ("r", "b", "park", *at, 3), ("q", "İsimsiz park", "park", 38.03, 27.03, 4), ("s", "c", "park", None, 27.0, 5), (None, "d", "park", 38.02, 27.02, 6)]
    places = spark.createDataFrame(rows, "id string, name string, taxonomy string, latitude double, longitude double, position int")
    registry = spark.createDataFrame([("p", "a", "P", *at)], "id string, name string, city string, latitude double, longitude double")
    corners = [(27.0, 38.0), (27.1, 38.0), (27.1, 38.1), (27.0, 38.1), (27.0, 38.0)]
    province = spark.createDataFrame([("P", *a, *b) for a, b in zip(corners, corners[1:])], "region string, x1 double, y1 double, x2 double, y2 double")
    told = {r["position"]: (r["outcome"], r["target_id"]) for r in gap_analysis(places, registry, province, ["park"]).collect()}
    assert told == {1: ("REJECT_NON_PARK", None), 2: ("MATCHED_EXISTING", "p"), 3: ("DUPLICATE_SOURCE", None), 4: ("STRONG_NEW", None), 5: ("INVALID", None), 6: ("STRONG_NEW", None)}


def test_regions_match_sql_over_many_blocks(spark, data, tmp_path):
    """Parks of every other column of blocks, so that regions reach over degrees."""
    import os

    import duckdb

    for t in ("nation", "part"):
        os.symlink(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"copy (select c_custkey + 64000 * (c_custkey % 8) as c_custkey, c_nationkey from '{data}/customer.parquet') to '{tmp_path}/customer.parquet' (format parquet)")
    for name in ("resolved_districts", "normalized_regions"):
        df = QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        for t in ("nation", "part", "customer"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        found = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
