"""The ways taken at scale, forced on small data: no broadcast, every repeated key frequent, every page deep."""

import pytest

from csvharbor.operators import joins, views
from csvharbor.plans import ingest
from csvharbor.session import cut
from csvharbor.sources import records
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = (
    "existing_keys_single existing_keys_composite duplicate_lines classify_rows preview_summary update_diff delete_keys_single"
    " delete_keys_composite delete_audit point_lookups update_cell rejected_edits key_collision bulk_edit bulk_edit_unmatched"
    " rollback_load rollback_marks_loads uploads_join_rows failed_rows_delete rows_outlive_upload unique_append template_match"
    " initial_mapping table_page page_past_the_end audit_page failed_page load_page csv_roundtrip load_job preview_job"
).split()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_same_results(spark, db, name, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(views, "DEEP_OFFSET", -1)
    monkeypatch.setattr(records, "MAX_BROADCAST_SPLITS", -1)
    monkeypatch.setattr(ingest, "MAX_FILES_BROADCAST", -1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert difference(spark, db, SF_DIR, name) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rare_keys_are_not_counted_one_by_one(spark, monkeypatch):
    left = spark.createDataFrame([(k % 7, None if k == 3 else k % 5, k) for k in range(50)], "a int, b int, n int")
    right = spark.createDataFrame([(a, b, "x") for a in range(4) for b in range(5)], "a int, b int, v string")
    written = []
    monkeypatch.setattr(joins, "cut", lambda df: written.append(df.columns) or cut(df))
    for hot_rows, cuts in ((5_000_000, []), (1, [["a", "b"], ["a", "b", "v"]])):
        got = joins.split_join(left, right, ["a", "b"], "left", hot_rows).select("n", "v")
        assert written == cuts
        assert sorted((r.n, r.v or "") for r in got.collect()) == [(k, "x" if k % 7 < 4 and k != 3 else "") for k in range(50)]
        written.clear()
