"""Side tables of a store (keys, summaries) and the key gate of a stream."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from csvharbor.operators import filters, views
from csvharbor.operators.history import UPLOAD_SCHEMA
from csvharbor.operators.joins import distinct_keys
from csvharbor.operators.views import column_profile
from csvharbor.plans import ingest, lookup, preview, publish
from csvharbor.sources import keys as keys_module
from csvharbor.sources import orders
from csvharbor.sources.grams import fragments
from csvharbor.sources.store import Store
from csvharbor.specs import FieldSpec, FieldType, Registry, TableSpec
from csvharbor.streaming import drop
from csvharbor.streaming.unique import KeyGate

AS_OF = dt.datetime(2026, 6, 1)
PAIRS = TableSpec("pairs", "Test", "Pairs", "Pairs", ("A", "B"), (FieldSpec("A"), FieldSpec("B"), FieldSpec("N", FieldType.NUMERIC), FieldSpec("D", FieldType.DATE)))
SINGLE = TableSpec("single", "Test", "Single", "Single", ("A",), PAIRS.fields)


def make(spark, path, **sides):
    registry = Registry()
    registry.register(PAIRS)
    registry.register(SINGLE)
    return Store(spark, str(path), registry, buckets=8, **sides)


def put(store, batch, lines, spec=PAIRS):
    """A committed batch of one upload, without the way over files."""
    spark, parts = store.spark, [line.split(",") for line in lines]
    rows = [(f"u-{batch}", k, *(c or None for c in p[:3]), p[3] or None) for k, p in enumerate(parts)]
    read = spark.createDataFrame(rows, "upload_id string, line_number long, a string, b string, n string, d string")
    typed = [F.col(f.column).cast(spec.schema()[f.column].dataType).alias(f.column) for f in spec.fields]
    nothing = [F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<string>").alias("row_data")]
    store.write(spec.key, batch, read.select("upload_id", "line_number", *nothing, *typed, F.lit("accepted").alias("outcome")), partition_by=["outcome"])
    given = {"id": f"u-{batch}", "name": spec.key, "file_name": f"{batch}.csv", "status": "active", "seq": 0}
    store.write("uploads", f"{spec.key}-{batch}", spark.createDataFrame([tuple(given.get(f.name) for f in UPLOAD_SCHEMA.fields)], UPLOAD_SCHEMA))
    store.commit([(spec.key, batch, 0), ("uploads", f"{spec.key}-{batch}", 0)])
    store.settle(spec.key)


def filled(spark, tmp_path, spec=PAIRS, **sides):
    store = make(spark, tmp_path / "store", **sides)
    for k in range(4):
        put(store, f"l{k}", [f"a{i},b{i % 3},{i}.5,2024-01-{1 + i % 28:02d}" for i in range(k * 30, k * 30 + 30)] + [f",none{k},,"], spec)
    return store


def keys_of(spark, *names, spec=PAIRS):
    return spark.createDataFrame([(n, f"b{int(n[1:]) % 3}")[: len(spec.unique_key)] for n in names], ", ".join(f"{c} string" for c in spec.key_columns))


def change(spark, store, spec=PAIRS):
    publish.delete(store, spec, keys_of(spark, "a5", "a6", spec=spec), "del", AS_OF)
    edits = keys_of(spark, "a35", "a36", spec=spec).withColumn("column", F.lit("N")).withColumn("value", F.lit("-7"))
    publish.edit(store, spec, edits, "edit", AS_OF)
    gone = store.uploads().filter("file_name = 'l3.csv'").select("id")
    ingest.rollback(store, gone, "undo", AS_OF)


@pytest.mark.parametrize("spec", [PAIRS, SINGLE])
def test_key_table_follows_the_rows(spark, tmp_path, spec):
    store = filled(spark, tmp_path, spec, keyed=True)
    change(spark, store, spec)
    plain = make(spark, tmp_path / "store")
    order = [*spec.key_columns, "digest", "upload_id", "batch", "gen"]
    rows = sorted(tuple(r) for r in store.keys(spec.key).select(order).collect())
    assert rows == sorted(tuple(r) for r in plain.keys(spec.key).select(order).collect()) and len(rows) == 88
    asked = keys_of(spark, "a1", "a5", "a35", "a95", "a999", spec=spec)
    assert sorted(r[0] for r in lookup.existing(store, spec, asked).collect()) == ["a1", "a35"]
    assert sorted((r.a, int(r.n * 10)) for r in lookup.rows_of(store, spec, asked).collect()) == [("a1", 15), ("a35", -70)]
    assert sorted(store.batches_of(spec.key, asked)) == ["l0", "l1"] and plain.batches_of(spec.key, asked) is None


def test_stored_side_is_not_moved(spark, tmp_path):
    store = filled(spark, tmp_path, keyed=True)
    wanted = distinct_keys(keys_of(spark, *[f"a{k}" for k in range(60)]), PAIRS.key_columns)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.keys("pairs").join(wanted, PAIRS.key_columns, "left_semi")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    stored = plan.split("FileScan parquet", 1)[0]
    left = plan[plan.index("SortMergeJoin") :]
    assert left.index("FileScan parquet spark_catalog") < left.index("Exchange hashpartitioning"), stored  # only the asked keys are dealt


def test_few_keys_open_their_buckets_and_batches(spark, tmp_path):
    store = filled(spark, tmp_path, SINGLE, keyed=True)
    asked = keys_of(spark, "a1", "a40", spec=SINGLE)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells the buckets
    try:
        plan = store.keys("single", asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    opened, total = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan).groups())
    assert opened <= 2 and total == 8
    read = lookup.rows_of(store, SINGLE, asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*batch#\d+ IN \((l0,l1|l1,l0)\)", plan) and read.count() == 2


def test_batches_that_are_not_covered_yet_are_read(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, keyed=True, summarized=True)
    monkeypatch.setattr(Store, "settle", lambda self, table: None)  # a stop between the commit and the side tables
    put(store, "late", ["z1,z2,1000,2024-02-02"])
    publish.delete(store, PAIRS, keys_of(spark, "a1"), "del", AS_OF)
    plain = make(spark, tmp_path / "store")
    same = lambda: (
        sorted(tuple(r) for r in store.keys("pairs").collect()) == sorted(tuple(r) for r in plain.keys("pairs").select(store.keys("pairs").columns).collect()),
        sorted(tuple(r) for r in lookup.column_profile(store, PAIRS).collect()) == sorted(tuple(r) for r in column_profile(plain.rows("pairs"), PAIRS).collect()),
    )
    assert same() == (True, True)
    monkeypatch.undo()
    store.settle("pairs")
    assert same() == (True, True) and store._uncovered("pairs", "keys").isEmpty()


def test_a_generation_left_behind_is_not_used(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, keyed=True)
    with pytest.raises(RuntimeError), monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda self, places: (_ for _ in ()).throw(RuntimeError("lost")))
        publish.bulk_edit(store, PAIRS, keys_of(spark, *[f"a{k}" for k in range(30)]), "N", "99", "never", AS_OF)
    publish.delete(store, PAIRS, store.rows("pairs").filter("upload_id = '%s'" % store.uploads().filter("file_name = 'l0.csv'").first().id).select("a", "b"), "all", AS_OF)
    left = {r.a for r in store.rows("pairs").collect() if r.a}
    assert left == {f"a{k}" for k in range(30, 120)} == {r.a for r in store.keys("pairs").collect()}


def test_summaries_follow_the_rows(spark, tmp_path):
    store = filled(spark, tmp_path, summarized=True)
    change(spark, store)
    put(store, "empty", [])
    rows = make(spark, tmp_path / "store").rows("pairs")
    assert [tuple(r) for r in lookup.column_profile(store, PAIRS).collect()] == [tuple(r) for r in column_profile(rows, PAIRS).collect()]
    assert lookup.column_profile(store, PAIRS).dtypes == column_profile(rows, PAIRS).dtypes
    assert lookup.table_counts(store, [PAIRS, SINGLE]).collect() == [("pairs", rows.count()), ("single", 0)]
    stats = {r.table_key: r.row_count for r in lookup.table_stats(store, [PAIRS, SINGLE]).collect()}
    assert stats == {"pairs": rows.count(), "single": 0}
    facts = {r.column_name: r for r in lookup.column_facts(store, PAIRS).collect()}
    numbers = sorted(float(r.n) for r in rows.collect() if r.n is not None)
    assert facts["A"].nulls == 3 and facts["A"].distinct == 88 and (facts["B"].least, facts["B"].greatest) == ("b0", "none2")
    assert facts["N"].rows == rows.count() and all(abs(q - numbers[int(s * len(numbers))]) <= 2 for q, s in zip(facts["N"].quantiles, (0.25, 0.5, 0.75)))
    assert facts["D"].least == "2024-01-01" and facts["D"].quantiles is None
    scanned = lookup.column_profile(store, PAIRS).inputFiles()
    assert scanned and all("/_summaries/" in f or "/cut-" in f or "/uploads/" in f or "/_commits/" in f or "/_covered/" in f for f in scanned)


def test_empty_store(spark, tmp_path):
    store = make(spark, tmp_path / "store", keyed=True, summarized=True)
    assert store.keys("pairs").count() == 0 and lookup.table_counts(store, [PAIRS]).first().row_count == 0
    assert [(r.column_name, r.sum, r.avg, r["count"]) for r in lookup.column_profile(store, PAIRS).collect()] == [("N", None, None, 0)]
    assert lookup.existing(store, PAIRS, keys_of(spark, "a1")).count() == 0


@pytest.mark.parametrize("pattern, parts", [("abc", ["abc"]), ("a%bcd_efg", ["bcd", "efg"]), ("10\\%off", ["10%off"]), ("a_b%c", []), ("", []), ("\\\\ab", ["\\ab"])])
def test_fragments(pattern, parts):
    assert fragments(pattern) == parts


def test_search_opens_the_files_that_can_match(spark, tmp_path):
    store = make(spark, tmp_path / "store", searched=True)
    texts = [["Straße West", "İstanbul", "alpha beta"], ["Alphabet", "100% wool", "x_y_z"], ["gamma", "delta alp", ""], ["ΣΑΣ", "tab\tbed", "woo%l"]]
    for k, lines in enumerate(texts):
        put(store, f"l{k}", [f"{t},{t[:2]}{k},1," for t in lines if "," not in t])
    plain = store.rows("pairs")
    for text in ("alpha", "ALP", "al", "%", "a%bet", "l_h", "straße", "STRASSE", "istanbul", "σας", "0% w", "x_y", "tab\tb", "zzz", "100\\%", "lpha b"):
        for literal in (False, True):
            got = lookup.search(store, PAIRS, text, literal)
            assert sorted(r.a for r in got.collect()) == sorted(r.a for r in filters.search(plain, text, PAIRS, literal).collect()), text
        for op in ("contains", "starts", "ends", "eq"):
            asked = filters.Filter("a", op, text)
            assert sorted(r.a for r in lookup.matching(store, PAIRS, asked).collect()) == sorted(r.a for r in filters.apply_filters(plain, [asked]).collect()), (text, op)
    data = lambda df: {f.split("batch=")[1].split("/")[0] for f in df.inputFiles() if "/pairs/batch=" in f}
    assert data(lookup.search(store, PAIRS, "alphab")) == {"l1"} and data(lookup.search(store, PAIRS, "al")) == {"l0", "l1", "l2", "l3"}
    assert data(lookup.search(store, PAIRS, "zzz")) == set()


def test_search_after_changes(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path, searched=True)
    change(spark, store)
    monkeypatch.setattr(Store, "settle", lambda self, table: None)
    put(store, "late", ["a350,b,1,"])
    plain = make(spark, tmp_path / "store").rows("pairs")
    for text in ("a35", "a11", "none", "b1"):
        assert sorted(map(tuple, lookup.search(store, PAIRS, text).collect()), key=str) == sorted(map(tuple, filters.search(plain, text, PAIRS).collect()), key=str)


def test_preview_by_digest(spark, tmp_path):
    store = filled(spark, tmp_path, keyed=True)
    put(store, "twice", ["a7,b1,7.5,2024-01-08", "a8,b2,1,2024-01-08"])  # keys that stand twice
    change(spark, store)
    folder = tmp_path / "new"
    folder.mkdir()
    lines = ["a1,b1,1.50,2024-01-02", "a2,b2,3,2024-01-03", "a3,b0,,2024-01-04", "a5,b2,5.5,2024-01-06", "a7,b1,7.5,2024-01-08", "a8,b2,8.5,2024-01-09", "a35,b2,-7,2024-01-08", "q,q,1,", "a4,b1,4.5,2024-01-05", "a4,b1,x,"]
    (folder / "f.csv").write_text("\n".join(["A,B,N,D", *lines]) + "\n")
    data = ingest.incoming(spark, PAIRS, str(folder))
    by_digest, plain = lookup.previewed(store, data, 2026), preview.preview(data, make(spark, tmp_path / "store").rows("pairs"), 2026)
    for name in ("rows", "summary", "new", "updates", "errors", "duplicates", "duplicate_lines"):
        one, two = getattr(by_digest, name), getattr(plain, name)
        assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, two.select(sorted(two.columns)).collect())), name
    changed = {(r.line_number, tuple(r.changed)) for r in by_digest.updates.collect()}
    assert {(2, ()), (3, ("N",)), (8, ())} <= changed


ORDERS = {"pairs": [(("N", "desc"), ("B", "asc")), (("B", "desc"),)]}


@pytest.mark.parametrize("rows", [orders.RANGE_ROWS, 6])
def test_pages_of_ranges(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(orders, "RANGE_ROWS", rows)
    store = filled(spark, tmp_path, sorted_by=ORDERS)
    change(spark, store)
    with monkeypatch.context() as m:
        m.setattr(Store, "settle", lambda self, table: None)
        put(store, "late", ["a350,é,1,", "a351,b,55.5,2024-01-02", "a352,,,"])
    rows = make(spark, tmp_path / "store").rows("pairs").select("a", "b", "n", "d")
    for sorts in ORDERS["pairs"]:
        order = views.ordering(sorts, PAIRS)
        for page in (1, 5, 1000):
            assert store.page("pairs", sorts, page, 10).collect() == views.page_rows(rows, order, page, 10).collect(), (sorts, page)
    if rows == 6:
        plan = store.page("pairs", ORDERS["pairs"][0], 3, 10)._jdf.queryExecution().executedPlan().toString()
        first, last = re.search(r"PartitionFilters: \[[^\]]*range#\d+ >= (\d+)\), \(range#\d+ <= (\d+)", plan).groups()
        assert 0 <= int(last) - int(first) <= 3
    assert make(spark, tmp_path / "other", sorted_by=ORDERS).page("pairs", ORDERS["pairs"][0], 4).collect() == []


def judged(spark, *rows):
    data = [(f"u{u}", line, None, [a, b], a, b, "accepted") for u, line, a, b in rows]
    return spark.createDataFrame(data, "upload_id string, line_number long, reason string, row_data array<string>, a string, b string, outcome string")


def outcome(df):
    return sorted((r.upload_id, r.line_number) for r in df.collect() if r.outcome == "accepted")


def test_key_gate(spark, tmp_path):
    gate = lambda: KeyGate(spark, str(tmp_path), PAIRS, dt.timedelta(hours=10))  # noqa: E731  a new one is a restart
    at = lambda hours: AS_OF + dt.timedelta(hours=hours)
    first = gate().admit("one", judged(spark, (1, 1, "x", "1"), (1, 2, "x", "1"), (1, 3, "x", "2"), (1, 4, None, "1"), (1, 5, None, "1")), at(0))
    assert outcome(first) == [("u1", 1), ("u1", 3), ("u1", 4), ("u1", 5)]
    assert [r.reason for r in first.collect() if r.line_number == 2] == ["duplicate key: A, B came before within 10:00:00"]
    retried = gate().admit("one", judged(spark, (1, 1, "x", "1"), (1, 3, "x", "2")), at(5))
    assert outcome(retried) == [("u1", 1), ("u1", 3)]
    assert outcome(gate().admit("two", judged(spark, (2, 1, "x", "1"), (2, 2, "y", "1")), at(9))) == [("u2", 2)]
    assert outcome(gate().admit("three", judged(spark, (3, 1, "x", "1"), (3, 2, "y", "1")), at(10))) == [("u3", 1)]
    assert outcome(gate().admit("back", judged(spark, (4, 1, "x", "2"), (4, 2, "x", "1")), at(2))) == [("u4", 1)]  # counts as at 10
    assert outcome(gate().admit("long after", judged(spark, (5, 1, "x", "1"), (5, 2, "y", "1")), at(500))) == [("u5", 1), ("u5", 2)]


def test_stream_holds_back_repeats(spark, tmp_path):
    store = make(spark, tmp_path / "store", keyed=True)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for k, (lines, hours) in enumerate([(["a1,b,1,", "a1,b,2,", "a2,b,1,"], 0), (["a1,b,3,", "a3,b,1,"], 1), (["a1,b,4,", "a3,b,2,"], 30)]):
        (inbox / f"{k}.csv").write_text("\n".join(["A,B,N,D", *lines]) + "\n")
        drop.start_load(
            store, PAIRS, str(inbox), str(tmp_path / "progress"), lambda h=hours: AS_OF + dt.timedelta(hours=h), unique_within=dt.timedelta(hours=24)
        ).awaitTermination()
    assert sorted((r.a, int(r.n)) for r in store.rows("pairs").collect()) == [("a1", 1), ("a1", 4), ("a2", 1), ("a3", 1), ("a3", 2)]
    assert sorted(tuple(r.row_data[:3]) for r in store.failed("pairs").collect()) == [("a1", "b", "2"), ("a1", "b", "3")]
    counts = sorted((r.total_rows, r.rows_inserted, r.rows_skipped) for r in store.uploads().collect())
    assert counts == [(2, 1, 1), (2, 2, 0), (3, 2, 1)]


def test_keys_of_many_rows_spread_over_more_files_than_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys_module, "ROWS_PER_FILE", 2)
    store = filled(spark, tmp_path, keyed=True)
    change(spark, store)
    plain = make(spark, tmp_path / "store")
    columns = store.keys("pairs").columns
    assert sorted(map(tuple, store.keys("pairs").collect())) == sorted(map(tuple, plain.keys("pairs").select(columns).collect()))
    written = spark.read.parquet(str(tmp_path / "store" / "_keys" / "pairs")).select("attempt", F.col("_metadata.file_name").alias("file"))
    assert max(r.n for r in written.distinct().groupBy("attempt").agg(F.count("*").alias("n")).collect()) > 8
    assert sorted(r[0] for r in lookup.rows_of(store, PAIRS, keys_of(spark, "a1", "a35", "a999")).select("a").collect()) == ["a1", "a35"]
