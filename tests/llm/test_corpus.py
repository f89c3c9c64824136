"""Mixing, quality rules, the pipeline, and the registered queries."""

import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from csvharbor.llm import QUERIES, bpe, mixing, quality, registry
from csvharbor.operators import joins
from tests.compare import difference, sorted_rows
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, size string, copies int")
    return mixing.mix(df, **options).collect()


def near(rows, got, slack):
    sizes, taken = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    wanted = brute.targets(sizes)
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= slack, (source, words, wanted[source])


@pytest.mark.parametrize("slice_rows", [1000, 20])
def test_mix_comes_to_its_targets(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = [(k, "w " * (k * 37 % 90 + 1), ["a", "b", "B", "é", "\U0001f600", None, "hot", "hot", "hot"][k % 9]) for k in range(900)]
    got = mixed(spark, rows)
    assert len(got) == 900 and {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t, _ in rows}
    near(rows, got, 60 if slice_rows == 20 else 6)
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows[::-1])))


def test_mix_of_odd_documents(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z", None), (4, "w " * 60_000, "c"), (5, None, "empty")]
    got = mixed(spark, rows)
    near(rows, got, 90_000)
    assert sorted((r.size, r.source_size) for r in got) == [(0, 0), (0, 4), (0, 4), (2, 4), (2, 4), (3, 3), (60_000, 60_000)]
    assert mixed(spark, []) == [] and [r.copies for r in mixed(spark, [(1, None, None)])] == [1]


def test_mix_deals_rows_alike_to_many_slices(spark, monkeypatch):
    rows = [(None, "two words", "a")] * 3000 + [(7, "one", "a")] * 500 + [(k, "w " * (k % 9 + 1), "b") for k in range(500)]
    seen = []
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    plain = mixing._rounded

    def watched(most):
        work, widest = plain(most), spark.sparkContext.accumulator(0)
        seen.append(widest)

        def rounded(slice_):
            widest.add(int(slice_["alike"].sum() > 1000))
            return work(slice_)

        return rounded

    monkeypatch.setattr(mixing, "_rounded", watched)
    got = mixed(spark, rows)
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(t.split())) for i, t, _ in rows)
    assert seen[0].value == 0
    near(rows, got, 80)


def test_targets_of_many_sources(spark):
    rows = [(k, "w " * (1 + (k * k) % 50), f"s{k % 40:02d}") for k in range(200)]
    near(rows, mixed(spark, rows), 30)


def test_a_step_of_mixing_joins_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(mixing, "cut", lambda df, cut=mixing.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    cells = spark.createDataFrame([(False, "a", 3, 5), (False, "a", 40, 7), (True, "", 9, 2)], "void boolean, name string, size long, rows long")
    aims = spark.createDataFrame([(False, "a", 295, 12, 200.0), (True, "", 18, 2, 30.0)], "void boolean, name string, words long, rows long, target double")
    found = {r.name: r for r in mixing.tilts(cells, aims).collect()}
    assert (found["a"].words, found["a"].rows, found["a"].target) == (295, 12, 200.0) and found["a"].tilt < 0 < found[""].tilt
    assert len(plans) > 2 and max(p.count("Join ") for p in plans) == 1


def test_tilt_solves_the_dual(spark):
    cells = spark.createDataFrame([(False, "a", s, 1) for s in range(1, 101)], "void boolean, name string, size long, rows long")
    for target in (500.0, 5050.0, 9000.0, 10_099.0):
        aims = spark.createDataFrame([(False, "a", 5050, 100, target)], "void boolean, name string, words long, rows long, target double")
        got = mixing.tilts(cells, aims).first()
        assert sum(s * min(2.0, 2.718281828459045 ** (got.tilt * s / got.mean)) for s in range(1, 101)) == pytest.approx(target, rel=1e-5)


def own(k, n):
    """A line that differs from those of other numbers in letters; digits do not count."""
    return " ".join(f"{k:03d}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(n))


def judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("name", F.lit(1))
    got = quality.judge(df)
    db = duckdb.connect()
    arrow = df.select("doc_id", "text", "source").toPandas()
    db.register("documents", arrow.astype({"doc_id": "Int64"}))
    cursor = db.execute(quality.JUDGE_SQL)
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = sorted_rows(got.columns, [tuple(r) for r in got.collect()]), sorted_rows(columns, cursor.fetchall())
    assert mine == theirs
    return {r.doc_id: r for r in got.collect()}


def test_quality_by_sql(spark):
    menu = "Home | About 12 | Contact us\n"
    rows = [(k, menu * 2 + f"Text {k} of its own with enough words to be kept, number {k} of many\n" * 1, "a") for k in range(30)]
    rows += [(100 + k, menu + "short", "a") for k in range(5)] + [(200 + k, menu.upper() + " ".join(f"w{k}x{j}" for j in range(40)), None) for k in range(25)]
    rows += [
        (300, None, "a"), (301, "", "b"), (302, " \n\t\x0b\n", "b"), (303, "a b c d e " * 3, "b"), (304, "one\n one\none\n\n\none #$%&|<>*", "b"),
        (305, "x y z u v w x y z u v q " + " ".join(f"t{j}" for j in range(60)), "b"), (306, "ü漢字   ab " * 4, "b"), (307, " ".join(f"l{j}" for j in range(30_000)), "b"),
        (308, "a a a a a a a a a a a a", "b"), (309, "rep eat " * 20_000, "b"), (310, "dup", "b"), (310, "dup", "b"), (None, "no id", "b"),
    ]
    got = judged(spark, rows)
    assert got[309].n_repeat_words == 40_000 and got[307].kept and not got[100].kept and got[305].n_repeat_words == 10
    assert got[0].removed_chars > 0 and got[0].n_dup_lines == 1


def test_quality_of_nothing(spark):
    assert judged(spark, []) == {}


def test_depleted_documents_are_rejected(spark):
    rows = [(k, "The same line of many words stands on every page of the host\n" + f"own{k} " * 3, "h") for k in range(40)]
    rows += [(100 + k, own(k, 20), "h") for k in range(40)]
    got = judged(spark, rows)
    assert not got[0].base_failed and not got[0].kept and got[100].kept


@pytest.mark.parametrize("rows, hot", [(1_000_000, 5_000_000), (-1, 3), (-1, 100)])
def test_the_limit_of_lines_is_a_number_of_documents(spark, monkeypatch, rows, hot):
    """In a host of any size, and whether frequent lines are broadcast, joined apart or joined by shuffle."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    shared = "Sign in to read the rest of this page and many others\n"
    data = [(k, shared + own(k, 4), "large") for k in range(6)] + [(100 + k, own(10 + k, 20), "large") for k in range(300)]
    data += [(500 + k, shared + own(400 + k, 4), "small") for k in range(5)] + [(600 + k, shared + own(500 + k, 60), None) for k in range(6)]
    got = judged(spark, data)
    assert [got[k].kept for k in (0, 5, 100, 500, 600)] == [False, False, True, True, True]
    assert [got[k].removed_chars for k in (0, 500, 600)] == [53, 0, 53] and not got[0].base_failed


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """Documents whose way through the pipeline is known, beside given ones that the models learn from."""
    folder = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = given.where("doc_id = 219").first()
    own = [
        (10_001, base.text, "en", "planted", 1), (10_002, base.text, "en", "planted", 1), (10_003, base.text + " end", "en", "planted", 1),
        (10_004, "1234 5678 --- 99", "en", "planted", 1), (10_005, None, None, None, None), (10_006, base.text[:200] + " you idiot moron loser scum trash " * 20, "en", "planted", 1),
    ]
    given.union(spark.createDataFrame(own, given.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stage_by_stage(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, docs, fixture_dir))
        if name != "bpe":
            assert after.columns == docs.columns
        kept[name] = after
        docs = after
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    assert 10_006 not in ids["toxicity"] and {10_001, 10_004, 10_005} <= set(ids["toxicity"])
    assert not {10_004, 10_005} & set(ids["language"]) and 10_001 in ids["language"]
    rows = [(r.doc_id, r.text) for r in kept["language"].collect()]
    expected = sorted(i for i, (_, component) in brute.near_duplicates(rows, 5, 80).items() if i == component)
    assert sorted(ids["near_duplicates"]) == expected and not {10_001, 10_002, 10_003} & set(expected)
    sizes, target = {}, {}
    for r in kept["near_duplicates"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    for r in kept["mixing"].collect():
        target[r.source] = target.get(r.source, 0) + len(brute.words(r.text))
    for source, words in brute.targets(sizes).items():
        assert abs(target.get(source, 0) - words) <= max(30, 0.02 * words)
    tokens = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    texts = sorted((r.doc_id, r.text) for r in kept["mixing"].collect())
    coded = sorted(map(tuple, kept["bpe"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert coded == sorted((i, len(t := tokens.encode_ordinary(x)), sha(",".join(map(str, t)).encode()), sha(x.encode())) for i, x in texts)


CLASHING = "_rank long, _copies string, _row int, doc struct<a:int>, name string, copies int, id string, tags array<map<string,int>>, `odd name.x` map<string,string>"


def clashing(spark, rows):
    """Rows with further columns whose names the stages might use, and of types that cannot be compared."""
    full = [(*r, 7, "c", 3, (1,), "n", 9, "i", [{"k": 1}], {"a": "b"}) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def extras(rows):
    return {(r._rank, r._copies, r._row, r.doc.a, r.name, r.copies, r.id, str(r.tags), str(r["odd name.x"])) for r in rows}


def test_near_duplicate_stage_keeps_further_columns_and_other_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a, "en", "s", 1), (1, a, "de", "s", 1), (1, b, "en", "s", 1), (2, a + " more", "en", "s", 1), (3, b, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1), (4, None, None, None, None)]
    docs = clashing(spark, rows)
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    found = kept.collect()
    ids = lambda texts: sorted((r.doc_id, r.lang) for r in found if r.text in texts and r.doc_id is not None)
    assert ids([a, a + " more"]) in ([(1, "de")], [(2, "en")]) and ids([b]) in ([(1, "en")], [(3, "en")])
    assert len(found) == 5 and [r.text for r in found if r.doc_id is None] == [a, a] and [r.text for r in found if r.doc_id == 4] == [None]
    assert extras(found) == extras(docs.collect())


def test_mixing_stage_without_ids(spark):
    rows = [(None, "w " * 10, "en", "a", k) for k in range(900)] + [(k % 3, "v " * (k % 7 + 1), "en", "b", k) for k in range(600)] + [(5, None, None, None, None)]
    docs = clashing(spark, rows)
    taken = corpus_pipeline.mixed(spark, docs, "")
    assert taken.columns == docs.columns and taken.dtypes == docs.dtypes
    found = taken.collect()
    sizes = {"a": 9000, "b": sum(k % 7 + 1 for k in range(600)), None: 0}
    target = brute.targets(sizes)
    for source in ("a", "b"):
        of = [r for r in found if r.source == source]
        assert abs(sum(len(brute.words(r.text)) for r in of) - target[source]) <= 20, source
        assert max(Counter(r.n_chars for r in of).values()) <= 2
    assert [r.doc_id for r in found if r.source is None] == [5] and extras(found) == extras(docs.collect())


def test_pipeline_of_nothing(spark, tmp_path, fixture_dir):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{fixture_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_languages(spark):
    rows = [(1, "Some words of a text", None), (2, "123 --- !", None), (3, None, None), (None, "ähnlich", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for given in (docs, docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en"))):
        kept = corpus_pipeline.identified(spark, given, "").collect()
        assert {r.doc_id for r in kept} == {1, None} and len(kept) == 2


@pytest.fixture(scope="module")
def db():
    from tests.compare import connect

    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_cover_their_tables(spark, db, name, monkeypatch):
    if QUERIES[name].sql:
        from csvharbor import workload

        monkeypatch.setitem(workload.QUERIES, name, QUERIES[name])
        assert difference(spark, db, SMALL, name) is None
    else:
        table = {"op2": "pages", "op5": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
        assert QUERIES[name].run(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_python_workers_get_small_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(session):
        def told(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "rows"])

        rows = session.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("text"))
        return rows.mapInArrow(told, "size long, rows long")

    was = spark.conf.get(limit, None)
    try:
        spark.conf.unset(limit)
        got = registry.reached(sizes)(spark).collect()
        assert sum(r.rows for r in got) == 64 and max(r.size for r in got) < 5 << 20
        spark.conf.set(limit, "8m")  # a limit of the session's own stays
        assert registry.reached(sizes)(spark).agg(F.max("size")).first()[0] > 5 << 20 and spark.conf.get(limit) == "8m"
    finally:
        spark.conf.set(limit, was) if was else spark.conf.unset(limit)
