"""What may not get lost: files, numbers, edits, repeated lines of several files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from csvharbor.functions import cells
from csvharbor.operators import changes, joins
from csvharbor.plans import ingest, preview
from csvharbor.sources import records
from csvharbor.sources.store import Store
from csvharbor.specs import FieldSpec, FieldType, Registry, TableSpec
from csvharbor.streaming import drop

AS_OF = dt.datetime(2026, 6, 1)
ITEMS = TableSpec("items", "Test", "Items", "Items", ("Id",), (FieldSpec("Id", required=True, allow_empty=False), FieldSpec("Amount", FieldType.NUMERIC)))


@pytest.fixture
def store(spark, tmp_path):
    registry = Registry()
    registry.register(ITEMS)
    return Store(spark, str(tmp_path / "store"), registry)


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_two_drop_folders_and_a_repeated_micro_batch(spark, store, tmp_path):
    one, two = put(tmp_path / "d1", "a.csv", "Id,Amount\n1,1\n"), put(tmp_path / "d2", "a.csv", "Id,Amount\n2,2\n")
    for folder, checkpoint in ((one, "c1"), (two, "c2"), (two, "c2")):
        drop.start_load(store, ITEMS, folder, str(tmp_path / checkpoint), lambda: AS_OF).awaitTermination()
    assert sorted(r.id for r in store.rows("items").collect()) == ["1", "2"]
    commits = sorted((tmp_path / "c2" / "commits").glob("[0-9]*"))
    for commit in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the driver had died before the commit
        commit.unlink(missing_ok=True)
    drop.start_load(store, ITEMS, two, str(tmp_path / "c2"), lambda: AS_OF).awaitTermination()
    assert store.rows("items").count() == 2


def test_every_file_has_an_outcome(spark, store, tmp_path):
    folder = put(tmp_path / "in", "good.csv", "Id,Amount\n1,1\n")
    for name, text in (("empty.csv", ""), ("blank.csv", "\n\n\r\n"), ("other.csv", "nothing\n")):
        put(tmp_path / "in", name, text)
    result = ingest.load(store, ITEMS, folder, "b", AS_OF)
    assert [r.file_name for r in result.uploads.collect()] == ["good.csv"]
    rejected = {r.file.rsplit("/", 1)[1]: r.error for r in result.rejected_files.collect()}
    assert rejected == {"empty.csv": "empty file", "blank.csv": "empty file", "other.csv": "header not found (expected: Id, Amount)"}


def test_numbers_are_kept_or_refused(spark, store, tmp_path):
    texts = ["-$500.00", "500$", "+$5", "$-1,500.5", "(2)", "12345678901234567890", "0.12345678901", "0.12345678900", "abc", "00000000000000000000001"]
    folder = put(tmp_path / "in", "n.csv", "Id,Amount\n" + "".join(f'{k},"{t}"\n' for k, t in enumerate(texts)))
    ingest.load(store, ITEMS, folder, "b", AS_OF)
    assert {r.id: r.amount and float(r.amount) for r in store.rows("items").collect()} == {
        "0": -500, "1": 500, "2": 5, "3": -1500.5, "4": -2, "7": 0.123456789, "8": None, "9": 1,
    }
    assert {r.line_number: r.reason for r in store.failed("items").collect()} == {
        7: 'number out of range for "Amount": "12345678901234567890"', 8: 'number out of range for "Amount": "0.12345678901"',
    }


def test_last_edit_of_a_cell_counts(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, amount int").withColumn("amount", F.col("amount").cast("decimal(28,10)"))
    rows = [("a", "Amount", "9", 1), ("a", "AMOUNT", "10", 2), ("a", "amount", "10", 2), ("b", "amount", "bad", 2), ("b", "Amount", "5", 1), ("b", "Amount", "5", 1)]
    edits = spark.createDataFrame(rows, "id string, column string, value string, at int")
    out = changes.update_cells(table, edits, ITEMS, 2026, order="at")
    assert {r.id: int(r.amount) for r in out.rows.collect()} == {"a": 10, "b": 2}
    assert sorted((r.id, r.value, r.status) for r in out.rejected.collect()) == [
        ("a", "10", "superseded"), ("a", "9", "superseded"), ("b", "5", "superseded"), ("b", "bad", "invalid"),
    ]


def test_repeated_lines_of_several_files(spark, tmp_path):
    put(tmp_path / "in", "x.csv", "Id,Amount\n1,1\n")
    folder = put(tmp_path / "in", "y.csv", "Id,Amount\n1,1\n1,2\n")
    shown = preview.preview(ingest.incoming(spark, ITEMS, folder), spark.createDataFrame([], ITEMS.schema()), 2026)
    lines = [(r.file.rsplit("/", 1)[1], r.line_number, r.is_first) for r in shown.duplicate_lines.orderBy("file", "line_number").collect()]
    assert lines == [("x.csv", 2, True), ("y.csv", 2, False), ("y.csv", 3, False)]
    (one,) = shown.samples()["duplicate"].collect()
    assert (one.n_rows, one.first_file.rsplit("/", 1)[1], one.first_line, one.last_line, one.extra) == (3, "x.csv", 2, 3, 2)


def test_line_numbers_do_not_hang_on_the_splits(spark, tmp_path):
    folder = put(tmp_path / "in", "a.csv", "Id,Amount\n" + "".join(f"{k},{k}\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = records.scan(spark, folder, ITEMS.names)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        rows = found.records.filter("record_no > 1").select("record_no", F.split("raw", ",")[0].cast("int").alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.record_no, r.k) for r in rows) == [(k + 2, k) for k in range(3000)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_without_a_key_stay_out_of_the_shuffle(spark, how):
    left = spark.createDataFrame([(k % 3 if k % 2 else None, k) for k in range(40)], "key int, k int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "key int, v string")
    got = joins.split_join(left, right, ["key"], how, hot_rows=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "key", how).select(got.columns).collect()))


def test_rollback_counts_what_is_there(spark, store, tmp_path):
    folder = put(tmp_path / "in", "a.csv", "Id,Amount\n1,1\n2,2\n3,3\n")
    upload = ingest.load(store, ITEMS, folder, "b", AS_OF).uploads.first().id
    keep = lambda df: df.filter("id <> '2'")
    store.rewrite("items", keep, store.placed_rows("items").select("batch"))
    done = ingest.rollback(store, spark.createDataFrame([(upload,)], "id string"), "r", AS_OF).first()
    assert (done.rows_deleted, done.reason) == (2, None) and store.rows("items").count() == 0


def test_number_text(spark):
    rows = spark.createDataFrame([("$1,2.50",), ("(3",), ("x",)], "t string").select(cells.number_text(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["12.50", "", ""]


def test_numbers_without_brackets_need_one_pattern(spark):
    texts = ["$1,2.50", "(3", "(3)", "($ 1,000.5)", "\x01 5", "$\x01 5", "-$7", " 8 ", "9.", ".5", "(-4)", "", None, "1" * 18, "1" * 19, "0." + "1" * 11, "$" + ",1" * 9, "12345678901"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [tuple(r) for r in rows.orderBy("k").select(cells.number_text(F.col("t")), cells.number_too_long(F.col("t"))).collect()]
    plain = ["12.50", "", "-3", "-1000.5", "-5", "-5", "-7", "8", "9.", ".5", "", "", None, "1" * 18, "1" * 19, "0." + "1" * 11, "1" * 9, "12345678901"]
    assert [g[0] for g in got] == plain
    assert [k for k, g in enumerate(got) if g[1]] == [14, 15]
    shown = rows.select(F.when(F.col("k") < 0, cells.number_text(F.col("t"))))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("CASE WHEN (Contains") < shown.index("regexp_replace")  # a bracket is looked for before it is undone


def test_edited_values_are_judged_once(spark, monkeypatch):
    """Each edit is judged before the rows are split, and edits that move no key are not compared with the table."""
    table = spark.createDataFrame([(k, "x") for k in range(9)], "k long, t string").withColumn("k", F.col("k").cast("decimal(28,10)"))
    own = TableSpec("own", "Sales", "own", "own", ("k",), (FieldSpec("k", FieldType.NUMERIC), FieldSpec("t", FieldType.TEXT)))
    edits = spark.createDataFrame([(1, "t", "y"), (2, "T", "z"), (2, "t", "a"), (3, "none", "b"), (None, "t", "c")], "k long, column string, value string").withColumn("k", F.col("k").cast("decimal(28,10)"))
    plans = []
    monkeypatch.setattr(changes, "cut", lambda df, cut=changes.cut: plans.append(df.columns) or cut(df))
    monkeypatch.setattr(joins, "existing_keys", lambda *_: pytest.fail("no key moves"))
    allowed, rejected = changes.check_edits(table, edits, own, 2026)
    shown = lambda df, *names: sorted((tuple(r) for r in df.select(F.col("k").cast("int"), *names).collect()), key=str)
    assert shown(allowed, "column", "value") == sorted([(1, "t", "y"), (2, "T", "z"), (None, "t", "c")], key=str)
    assert shown(rejected, "column", "value", "status") == [(2, "t", "a", "superseded"), (3, "none", "b", "invalid")]
    assert [*own.key_columns, "column", "value", "stored", "reason"] in plans
    monkeypatch.undo()
    clash = spark.createDataFrame([(1, "k", "2"), (3, "k", "70"), (4, "k", "70")], "k long, column string, value string").withColumn("k", F.col("k").cast("decimal(28,10)"))
    allowed, rejected = changes.check_edits(table, clash, own, 2026)
    assert shown(allowed, "value") == [(3, "70")] and shown(rejected, "value", "status") == [(1, "2", "duplicate_key"), (4, "70", "duplicate_key")]
