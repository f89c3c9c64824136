"""Files on disk to stored tables and back: load, preview, change, audit, retention, stream."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from csvharbor.functions.cells import normalize_us_state
from csvharbor.operators import audit, changes, exports
from csvharbor.plans import ingest, preview, retention
from csvharbor.shipped import shipped_registry
from csvharbor.sources.store import Store
from csvharbor.specs import FieldSpec, FieldType, TableSpec
from csvharbor.streaming import drop

AS_OF = dt.datetime(2026, 6, 1, 12)
PEOPLE = TableSpec(
    "people", "Test", "People", "People", ("Id",),
    (
        FieldSpec("Id", required=True, allow_empty=False),
        FieldSpec("Full Name"),
        FieldSpec("Joined", FieldType.DATE, required=True),
        FieldSpec("Amount", FieldType.NUMERIC),
        FieldSpec("Active", FieldType.BOOL),
        FieldSpec("State", normalizer=normalize_us_state),
    ),
)
HEADER = "Id,Full Name,Joined,Amount,Active,State"


@pytest.fixture
def store(spark, tmp_path):
    registry = shipped_registry()
    registry.register(PEOPLE)
    return Store(spark, str(tmp_path / "store"), registry)


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *lines, bom=False):
        text = "\n".join(lines) + "\n"
        (folder / name).write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
        return str(folder)

    return put


def sample(files):
    files(
        "a.csv", "Monthly report", HEADER + ",Extra",
        '1,"Doe, John",2024-01-15,"$1,234.56",yes,california',
        '="2", Ann ,1/5/2024,(10),N,TX,more,cells',
        " , ,,,,",
        "3,short",
        ",No Key,2024-01-15,1,yes,NY",
        "4,Bad Date,2024-13-01,1,yes,NY",
        '5,"two\nlines",20240115,abc,maybe,Ontario',
        bom=True,
    )
    return files("b.csv", HEADER.upper(), "6,Six,Jan 15; 2024,1,1,1", "7,Seven,15 Jan 2024,.5,0,new york")


def test_load(spark, store, files):
    folder = sample(files)
    files("c.csv", "nothing", "useful")
    result = ingest.load(store, PEOPLE, folder, "b1", AS_OF)
    uploads = {r.file_name: r for r in result.uploads.collect()}
    assert {n: (u.total_rows, u.rows_inserted, u.rows_skipped) for n, u in uploads.items()} == {
        "a.csv": (7, 3, 3), "b.csv": (2, 1, 1),
    }
    assert uploads["a.csv"].csv_headers[-1] == "Extra"
    rows = {r.id: r for r in store.rows("people").collect()}
    assert set(rows) == {"1", "2", "5", "7"}
    assert rows["1"].full_name == "Doe, John" and rows["1"].amount == Decimal("1234.56") and rows["1"].state == "CA"
    assert rows["2"].full_name == "Ann" and rows["2"].amount == -10 and rows["2"].active is False
    assert rows["5"].full_name == "two\nlines" and rows["5"].amount is None and rows["5"].active is None
    assert rows["7"].joined == dt.date(2024, 1, 15) and rows["7"].state == "NY"
    failed = sorted((r.line_number, r.reason) for r in store.failed("people").collect())
    assert failed == [
        (2, 'invalid date for "Joined": "Jan 15; 2024"'),
        (6, "expected 6 columns, got 2"),
        (7, 'empty required field "Id"'),
        (8, 'invalid date for "Joined": "2024-13-01"'),
    ]
    assert [r.file.rsplit("/", 1)[1] for r in result.rejected_files.collect()] == ["c.csv"]
    assert store.log("audit_log").filter("action = 'upload' and severity = 'high'").count() == 2

    again = ingest.load(store, PEOPLE, folder, "b1", AS_OF)
    assert again.uploads.count() == 2 and store.rows("people").count() == 4

    a = uploads["a.csv"]
    repair = exports.export_failed(store.failed("people"), a.id, a.csv_headers)
    assert repair.columns == ["_line", "_error", *HEADER.split(","), "Extra"]
    assert [(r["_line"], r["Id"], r["Full Name"]) for r in repair.collect()][0] == (6, "3", "short")

    done = ingest.rollback(store, spark.createDataFrame([(a.id,), ("nope",)], "id string"), "r1", AS_OF).collect()
    assert {r.id: (r.rows_deleted, r.reason) for r in done} == {a.id: (3, None), "nope": (None, "upload not found")}
    assert {r.id for r in store.rows("people").collect()} == {"7"}
    second = ingest.rollback(store, spark.createDataFrame([(a.id,)], "id string"), "r2", AS_OF).collect()
    assert second[0].reason == "upload already rolled back"


def test_uncommitted_batch_is_invisible(store, files):
    data = ingest.incoming(store.spark, PEOPLE, sample(files))
    store.write("people", "lost", ingest.judged(data, "lost", 2026), ["outcome"])
    assert store.rows("people").count() == 0 and store.failed("people").count() == 0


def test_strict_modes(store, files):
    folder = files("a.csv", HEADER, "1,x,2024-01-01,abc,yes,NY", '2,a "b" c,2024-01-01,1,yes,NY')
    ingest.load(store, PEOPLE, folder, "b1", AS_OF, strict=True, strict_quotes=True)
    assert sorted(r.reason for r in store.failed("people").collect()) == [
        'CSV parse error: bare or extraneous " in field', 'invalid numeric for "Amount": "abc"',
    ]


def test_mapping(store, files):
    folder = files("a.csv", "who,key,when,x,y,z", "Ann,9,2024-01-01,,,")
    mapping = {"Id": 1, "Full Name": 0, "Joined": 2, "Amount": 77, "Active": -1}
    ingest.load(store, PEOPLE, folder, "b1", AS_OF, mapping=mapping)
    row = store.rows("people").first()
    assert (row.id, row.full_name, row.joined, row.amount, row.state) == ("9", "Ann", dt.date(2024, 1, 1), None, None)


def test_preview(spark, store, files, tmp_path):
    ingest.load(store, PEOPLE, files("old.csv", HEADER, "1,Ann,2024-01-15,1200,yes,CA", "2,Bob,2024-01-15,5,no,TX"), "b1", AS_OF)
    folder = tmp_path / "next"
    folder.mkdir()
    lines = [HEADER, "1,Ann,2024-01-15,\"$1,200.00\",yes,CA", "2,Bobby,2024-01-15,5,no,TX", "3,New,2024-01-15,1,yes,NY",
             "3,Again,2024-01-15,1,yes,NY", "3,Third,2024-01-15,1,yes,NY", "4,Bad,never,1,yes,NY", ",,,,,", "x"]
    (folder / "n.csv").write_text("\n".join(lines))
    data = ingest.incoming(spark, PEOPLE, str(folder))
    for compare, expected in (("typed", {"1": [], "2": ["Full Name"]}), ("text", {"1": ["Joined"], "2": ["Full Name"]})):
        shown = preview.preview(data, store.rows("people"), 2026, compare=compare)
        found = {r.row_key: r.changed for r in shown.updates.collect()}
        if compare == "text":
            assert found == {"1": ["Amount", "Active"], "2": ["Full Name", "Active"]}
        else:
            assert found == expected
    assert shown.summary.first().asDict() == {
        "total_rows": 8, "new_rows": 3, "update_rows": 2, "error_rows": 2, "duplicate_in_file": 2,
    }
    assert [(r.row_key, r.n_rows, r.first_line, r.extra) for r in shown.duplicates.collect()] == [("3", 3, 4, 2)]
    assert sorted((r.line_number, r.is_first) for r in shown.duplicate_lines.collect()) == [(4, True), (5, False), (6, False)]
    errors = {r.line_number: r.errors for r in shown.samples()["error"].collect()}
    assert errors == {7: ['invalid date for "Joined": "never"'], 9: ["expected 6 columns, got 1"]}
    assert {k: v.count() for k, v in shown.samples().items()} == {"new": 3, "update": 2, "error": 2, "duplicate": 1}


def test_changes(spark, store, files):
    lines = [f"{i},Name {i},2024-01-15,{i},yes,NY" for i in range(1, 9)] + ["8,Copy,2024-01-15,1,no,TX"]
    ingest.load(store, PEOPLE, files("a.csv", HEADER, *lines), "b1", AS_OF)
    table = store.rows("people")
    keys = spark.createDataFrame([("8",), ("1",), ("99",)], "id string")
    gone = changes.delete_rows(table, keys, PEOPLE)
    assert sorted(r.id for r in gone.rows.collect()) == list("234567")
    assert sorted(r.row_key for r in gone.changes.collect()) == ["1", "8", "8"]

    edits = spark.createDataFrame(
        [("2", "Full Name", ""), ("2", "amount", "7"), ("3", "Amount", "abc"), ("4", "Id", "5"), ("5", "Id", "50"), ("6", "Id", "50"),
         ("7", "Nope", "x"), ("3", "Joined", "soon")],
        "id string, column string, value string",
    )
    out = changes.update_cells(table, edits, PEOPLE, 2026)
    rows = {r.id: r for r in out.rows.collect()}
    assert rows["2"].full_name is None and rows["2"].amount == 7 and rows["3"].amount == 3
    assert set(rows) == {"1", "2", "3", "4", "50", "6", "7", "8"}
    rejected = {(r.id, r.column): (r.status, r.reason) for r in out.rejected.collect()}
    assert rejected == {
        ("3", "Amount"): ("invalid", "invalid number format"),
        ("3", "Joined"): ("invalid", "invalid date format (use YYYY-MM-DD)"),
        ("4", "Id"): ("duplicate_key", "key already exists"),
        ("6", "Id"): ("duplicate_key", "key already exists"),
        ("7", "Nope"): ("invalid", "column not found: Nope"),
    }
    assert sorted((r.row_key, r.column_name, r.old_value, r.new_value) for r in out.changes.collect()) == [
        ("2", "Amount", "2", "7"), ("2", "Full Name", "Name 2", ""), ("5", "Id", "5", "50"),
    ]

    bulk = changes.bulk_edit(table, keys, "State", "TX", PEOPLE, 2026)
    assert bulk.summary.first().rows_affected == 3 and bulk.unmatched.first().id == "99"
    assert sorted((r.row_key, r.old_value) for r in bulk.changes.collect()) == [("1", "NY"), ("8", "NY")]
    for column, value, text in (("Id", "1", "unique key"), ("Nope", "1", "not found"), ("Amount", "x", "invalid value")):
        with pytest.raises(ValueError, match=text):
            changes.bulk_edit(table, keys, column, value, PEOPLE, 2026)
    assert changes.reset_table(table, "people").changes.first().n == 9

    placed = store.placed_rows("people")
    drop_keys = changes.delete_rows(placed, keys, PEOPLE)
    store.rewrite("people", lambda df: changes.delete_rows(df, keys, PEOPLE).rows, placed.join(keys, "id", "left_semi"))
    assert store.rows("people").count() == drop_keys.rows.count() == 6
    assert store.rows("people").filter("state = 'NY'").count() == 6


def test_split_join_matches_plain_join(spark):
    left = spark.range(2000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)).alias("k"), "id")
    left = left.unionByName(spark.range(3).select(F.lit(None).cast("long").alias("k"), "id"))
    right = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    from csvharbor.operators.joins import lookup_join

    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        split = lookup_join(left, right, ["k"], how, rows=0, hot_rows=100)
        assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()


def test_retention(spark, store):
    days = [("a", 10), ("b", 100), ("c", 200), ("d", 8 * 365)]
    for batch, part in (("one", days[:2]), ("two", days[2:])):
        log = spark.createDataFrame([(i, "cell_edit", AS_OF - dt.timedelta(days=n)) for i, n in part], "id string, action string, created_at timestamp")
        store.write("audit_log", batch, audit.entries(log))
        store.commit([("audit_log", batch, 0)])
    steps = retention.run(store, "keep-1", AS_OF)
    assert [(s.step, s.rows, s.error) for s in steps] == [("archive", 3, None), ("purge", 1, None)]
    assert [r.id for r in store.log("audit_log").collect()] == ["a"]
    assert sorted(r.id for r in store.log("audit_log_archive").collect()) == ["b", "c"]
    assert [s.rows for s in retention.run(store, "keep-2", AS_OF)] == [0, 0]


def test_stream(spark, store, files, tmp_path):
    folder = files("a.csv", HEADER, "1,A,2024-01-15,1,yes,NY")
    files("b.csv", HEADER, "2,B,2024-01-15,1,yes,NY", "3,C")
    check, done = str(tmp_path / "check"), str(tmp_path / "Uploaded")

    def run():
        query = drop.start_load(store, PEOPLE, folder, check, lambda: AS_OF, archive=done, max_files=1)
        query.awaitTermination()
        assert query.exception() is None
        return query

    query = run()
    assert sorted(r.id for r in store.rows("people").collect()) == ["1", "2"] and store.failed("people").count() == 1
    shown = drop.progress(store, query, PEOPLE, 2).first()
    assert (shown.phase, shown.files, shown.rows_inserted, shown.rows_skipped, shown.percent) == ("complete", 2, 2, 1, 100.0)
    files("d.csv", HEADER, "4,D,2024-01-15,1,yes,NY")
    run()
    assert sorted(r.id for r in store.rows("people").collect()) == ["1", "2", "4"]
    # Handled files move once a later micro-batch has committed; that of the last one is still in place.
    moved = {p.name for p in (tmp_path / "Uploaded").rglob("*.csv")}
    assert moved and moved < {"a.csv", "b.csv", "d.csv"}


@pytest.mark.parametrize("key", ["anrok_transactions", "ns_invoice_detail", "ns_so_detail"])
def test_shipped_tables(store, files, key):
    spec = store.registry.get(key)
    texts = {FieldType.TEXT: "x", FieldType.DATE: "Jan 15, 2024", FieldType.NUMERIC: "$1,234.50", FieldType.BOOL: "Yes"}
    good = ['"' + ("new jersey" if f.normalizer else texts[f.type]) + '"' for f in spec.fields]
    wrong = ["?" if f.type is not FieldType.TEXT else " " for f in spec.fields]
    folder = files("a.csv", "Title", ",".join(spec.names), ",".join(good), ",".join(wrong + ["more"]), "too,short")
    ingest.load(store, spec, folder, "b1", AS_OF)
    typed = {FieldType.TEXT: "x", FieldType.DATE: dt.date(2024, 1, 15), FieldType.NUMERIC: Decimal("1234.5"), FieldType.BOOL: True}
    shown = spec.display(store.rows(key))
    first, second = sorted((tuple(r) for r in shown.collect()), key=lambda r: r[0] is None)
    assert shown.columns == spec.names
    assert first == tuple("NJ" if f.normalizer else typed[f.type] for f in spec.fields)
    assert second == tuple("" if f.not_null else None for f in spec.fields)
    assert [(r.line_number, r.reason) for r in store.failed(key).collect()] == [(5, f"expected {len(spec.fields)} columns, got 2")]
    csv = exports.export_view(store.rows(key), spec).first().asDict()
    expected = {FieldType.TEXT: "x", FieldType.DATE: "2024-01-15", FieldType.NUMERIC: "1234.50", FieldType.BOOL: "Yes"}
    assert csv == {f.name: "NJ" if f.normalizer else expected[f.type] for f in spec.fields}


def test_unseen_keys(spark):
    incoming = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), (None, 4, "n"), (None, 5, "n")], "k string, line int, v string")
    table = spark.createDataFrame([("b",)], "k string")
    rows = sorted((r.k or "", r.line, r.v) for r in drop.unseen(incoming, table, ["k"], ["line"]).collect())
    assert rows == [("", 4, "n"), ("", 5, "n"), ("a", 1, "y")]
