import os

import pytest

from tidemark.operators import integrity
from tidemark.plans import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
def test_full_check_reports_all_snapshots_and_kinds(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("documents", "region"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    got = sorted(map(tuple, queries.QUERIES["integrity_check_full"](spark, SF_DIR).collect()))
    assert got == sorted(db.execute(queries.ORACLES["integrity_check_full"]).fetchall())
    assert {("missing_blob", f"root-{k}") for k in range(5)} <= set(got)
    assert {"broken_config", "broken_index", "broken_snapshot", "corrupt_blob"} <= {t for t, _ in got}


def test_lines_of_findings(spark):
    rows = [("broken_config", "x", None, None, None), ("missing_blob", "a", "s1", None, None), ("corrupt_blob", "b", None, "p", None), ("corrupt_blob", "c", "s2", "", None), ("missing_pack", "d", None, "d", 3), ("broken_key", "k", None, None, None)]
    found = spark.createDataFrame(rows, "type string, id string, snapshot_id string, pack_id string, blob_count bigint")
    want = ["broken_config config", "broken_key k", "corrupt_blob b (pack p)", "corrupt_blob c (snapshot s2)", "missing_blob a (snapshot s1)", "missing_pack d (3 blobs)"]
    lines = lambda most: [r.line for r in integrity.report_lines(found, most).orderBy("position").collect()]
    assert lines(6) == want
    assert lines(4) == [*want[:4], "and 2 more findings (see --findings-file)"]
    assert integrity.report_lines(found.limit(0)).collect() == []
