"""Operators that learn: language, toxicity, pseudo-likelihood."""

import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from csvharbor.llm import QUERIES, langid, pseudolikelihood, toxicity
from tests.llm import brute

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None, "en"), (2, "", "en"), (3, "123 --- !", "en"), (4, "word " * 100_000, None), (4, "word", "en"), (None, "word", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def held(spark, name, sf, modulus, value):
    got = QUERIES[name].run(spark, sf)
    crc = F.crc32(F.col("doc_id").cast("string")) % modulus == value
    assert got.where(F.col("held_out") != crc).count() == 0
    return got.where("held_out")


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    rows = held(spark, "op1_language_id", MIDDLE, 5, 0).join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows) > 1000
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_documents(spark, docs):
    model = langid.train(docs)
    rows = spark.createDataFrame(ODD, "doc_id long, text string, score string").select("doc_id", langid.predict(F.col("text"), model).alias("f")).collect()
    assert [r.f.lang == "und" for r in rows] == [True] * 3 + [False] * 3
    assert all(r.f.score == 0 and r.f.ambiguous for r in rows[:3])


def test_language_without_training_rows_or_with_one_language(spark, docs):
    none = langid.train(docs.where("false"))
    assert docs.select(langid.predict(F.col("text"), none)["lang"].alias("l")).distinct().collect()[0].l == "und"
    one = langid.train(docs.where("lang = 'de'"))
    assert [r.l for r in docs.select(langid.predict(F.col("text"), one)["lang"].alias("l")).distinct().collect()] == ["de"]
    assert docs.limit(0).select(langid.predict(F.col("text"), one)).count() == 0


def test_language_training_is_repeatable(docs):
    assert (langid.train(docs).weights == langid.train(docs.repartition(5)).weights).all()


@pytest.mark.parametrize("classes", [2, 3, 6, 9, 40])
def test_codewords_differ_and_split(classes):
    code = langid.codewords(classes)
    assert len({tuple(row) for row in code}) == classes and (np.abs(code.sum(0)) < classes).all()


def test_profiles_do_not_depend_on_neighbours():
    texts = ["one text", "", "Ünïcode zwei", "x"]
    together = np.vstack(list(langid.profiles(pa.array(texts))))
    alone = np.vstack([np.vstack(list(langid.profiles(pa.array([t])))) for t in texts])
    assert np.allclose(together, alone)


def test_marginals_by_all_taggings():
    rng = np.random.default_rng(4)
    model = toxicity.Model(turn=rng.normal(size=(2, 2)), begin=rng.normal(size=2))
    lengths = [1, 5, 3]
    emissions = rng.normal(size=sum(lengths)) * 2
    heads = np.cumsum([0, *lengths[:-1]])
    toxic, joint = toxicity.marginals(emissions, heads, model, pairs=True)
    for head, n in zip(heads, lengths, strict=True):
        e, mass, one = emissions[head : head + n], 0.0, np.zeros(n)
        pair = np.zeros((n, 2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            score = model.begin[tags[0]] + sum(x for x, t in zip(e, tags, strict=True) if t) + sum(model.turn[a, b] for a, b in itertools.pairwise(tags))
            mass += math.exp(score)
            one += math.exp(score) * np.array(tags)
            for k in range(1, n):
                pair[k, tags[k - 1], tags[k]] += math.exp(score)
        assert np.allclose(toxic[head : head + n], one / mass)
        assert np.allclose(joint[head + 1 : head + n], pair[1:] / mass)


def test_marginals_of_long_chains_stay_finite():
    rng = np.random.default_rng(5)
    model = toxicity.Model(turn=rng.normal(size=(2, 2)), begin=rng.normal(size=2))
    emissions = rng.normal(size=20_000) * 10
    toxic, _ = toxicity.marginals(emissions, np.array([0, 7, 9000]), model)
    part, _ = toxicity.marginals(emissions[9000:], np.array([0]), model)
    assert np.isfinite(toxic).all() and np.allclose(toxic[9000:], part)


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic")
    rows = held(spark, "op6_toxicity", MIDDLE, 4, 2).join(labels, "doc_id").collect()
    found, real, right = sum(r.predicted for r in rows), sum(r.toxic for r in rows), sum(r.predicted and r.toxic for r in rows)
    assert real > 80 and right >= 0.8 * real and right >= 0.85 * found
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_spans_are_the_offending_words(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    text = "A thing, İ you IDIOT moron; and the rest. Loser"
    rows = spark.createDataFrame([(text, "s"), ("and the rest of it", "s"), (None, None), ("", None), (text + " x" * 80_000, None)], "text string, spans string")
    got = [r.f for r in rows.select(toxicity.tag(F.col("text"), model).alias("f")).collect()]
    assert [text[s.start : s.end] for s in got[0].spans] == ["IDIOT moron", "Loser"] == [text[s.start : s.end] for s in got[4].spans]
    assert got[0].score >= 0.3 > got[1].score and not got[1].spans and got[2] == got[3]


def test_toxicity_without_labels(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.train(docs, some)
        assert all(0 <= r.s < 0.3 for r in docs.select(toxicity.tag(F.col("text"), model)["score"].alias("s")).collect())
    assert docs.limit(0).select(toxicity.tag(F.col("text"), toxicity.Model())).count() == 0


def test_toxicity_of_repeated_and_null_labels(spark):
    docs = spark.createDataFrame([(k, "bad awful" if k % 2 else "good fine") for k in range(160)] + [(None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(1, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.s >= 0.3 for r in docs.limit(4).select(toxicity.tag(F.col("text"), model)["score"].alias("s")).collect()] == [False, True, False, True]


def test_probabilities_add_up_and_match_a_plain_loop():
    model = pseudolikelihood.begin(np.arange(50, dtype=np.uint64) * np.uint64(977), np.arange(50, 0, -1), 5000)
    rng = np.random.default_rng(6)
    around = rng.integers(0, pseudolikelihood.PAD + 1, (1, 4))
    everything = np.arange(pseudolikelihood.PAD)
    assert np.isclose(np.exp(pseudolikelihood.log_probabilities(model, np.repeat(around, len(everything), 0), everything)).sum(), 1)
    p = model.parts
    x = np.concatenate([p["embed"][c] for c in around[0]])
    h = np.tanh(x @ p["inner"] + p["inner_bias"])
    high, low = h @ p["high"] + p["high_bias"], h @ p["low"] + p["low_bias"][7]
    plain = math.log(math.exp(high[7]) / np.exp(high).sum()) + math.log(math.exp(low[9]) / np.exp(low).sum())
    assert np.isclose(pseudolikelihood.log_probabilities(model, around, np.array([7 * 64 + 9]))[0], plain, atol=1e-5)


def test_contexts_end_at_texts():
    pad = pseudolikelihood.PAD
    got = pseudolikelihood.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 0, 0, 2, 2]))
    assert got.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad, pad, 5, pad], [pad, 4, pad, pad]]


def test_slopes_of_the_network():
    rng = np.random.default_rng(7)
    model = pseudolikelihood.begin(np.empty(0, np.uint64), np.empty(0, np.int64), 10)
    around, target = rng.integers(0, pseudolikelihood.PAD, (6, 4)), rng.integers(0, pseudolikelihood.PAD, 6)
    parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    huge = {k: np.full(v.shape, 1e12) for k, v in parts.items()}
    stepped = {k: v.copy() for k, v in parts.items()}
    pseudolikelihood.learn(stepped, huge, around, target, rate=1.0)
    loss = lambda p: -pseudolikelihood.log_probabilities(pseudolikelihood.Model(model.hashes, model.numbers, p), around, target).sum()
    for name, value in parts.items():
        slope = (value - stepped[name]) * 1e6
        place = np.unravel_index(np.abs(slope).argmax(), value.shape)
        moved = {k: v.copy() for k, v in parts.items()}
        moved[name][place] += 1e-5
        assert np.isclose((loss(moved) - loss(parts)) / 1e-5, slope[place], rtol=1e-2, atol=1e-4), name


def test_training_beats_word_shares(spark, docs):
    per_word = lambda model: docs.select(pseudolikelihood.score(F.col("text"), model).alias("f")).agg(F.sum("f.log_likelihood") / F.sum("f.words")).first()[0]
    assert per_word(pseudolikelihood.train(docs)) > per_word(pseudolikelihood.train(docs, rounds=0)) + 0.05


def test_likelihood_of_odd_documents(spark, docs):
    model = pseudolikelihood.train(docs, rounds=0)
    rows = spark.createDataFrame(ODD, "doc_id long, text string, words string").select("text", pseudolikelihood.score(F.col("text"), model).alias("f")).collect()
    assert [r.f.words for r in rows] == [len(brute.words(r.text)) for r in rows]
    assert [r.f.log_likelihood < 0 for r in rows] == [False, False, True, True, True, True] and rows[4].f == rows[5].f
    empty = pseudolikelihood.train(docs.where("false"))
    assert docs.where("false").select(pseudolikelihood.score(F.col("text"), empty)).count() == 0


@pytest.mark.parametrize("common", [400_000, 3584, 0])
def test_rare_words_have_their_own_shares(spark, monkeypatch, common):
    monkeypatch.setattr(pseudolikelihood, "COMMON", common)
    rows = [(k, " ".join(f"w{j}" for j in range(pseudolikelihood.KNOWN))) for k in range(100, 150)] + [(None, "seen " * 40), (60, "seen"), (60, "seen"), (61, "once"), (62, None), (63, "w7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = pseudolikelihood.counted(docs)
    model = pseudolikelihood.train(docs, rounds=0, counts=counts)
    got = pseudolikelihood.likelihoods(docs, model, counts).collect()
    alone = docs.select("text", pseudolikelihood.score(F.col("text"), model).alias("f")).collect()
    assert sorted(r.words for r in got) == sorted(r.f.words for r in alone) == [0, 1, 1, 1, 1, 40, *[pseudolikelihood.KNOWN] * 50]
    network = {r.text: r.f.log_likelihood for r in alone}
    more = lambda i: [r.log_likelihood for r in got if r.doc_id == i]
    assert more(60) == [pytest.approx(network["seen"] + math.log(42))] * 2 and more(None) == [pytest.approx(network["seen " * 40] + 40 * math.log(42))]
    assert more(61) == [pytest.approx(network["once"])] and more(62) == [0] and more(63) == [pytest.approx(network["w7"])]
    new = spark.createDataFrame([(1, "never"), (2, "seen")], "doc_id long, text string")
    shares = {r.doc_id: r.log_likelihood for r in pseudolikelihood.likelihoods(new, model, counts).collect()}
    assert shares[2] > shares[1] + 3


def test_rounds_mask_every_word_once():
    alone, beside = np.array([5]), np.array([3, 0, 5, 700])
    rows = lambda counts: np.repeat(np.arange(len(counts)), counts)
    for rounds in (1, 2, 3):
        turns = [pseudolikelihood.masked(rows(beside), beside, turn, rounds) for turn in range(rounds)]
        assert (np.sum(turns, 0) == 1).all() and all(turn.any() for turn in turns)
        for turn in range(rounds):
            assert (turns[turn][3:8] == pseudolikelihood.masked(rows(alone), alone, turn, rounds)).all()


def test_training_learns_from_every_word(monkeypatch):
    words, batches = " ".join(f"w{k % 700}" for k in range(5000)), []
    monkeypatch.setattr(pseudolikelihood, "learn", lambda parts, squares, around, target: batches.append(len(target)))
    model = pseudolikelihood.begin(np.empty(0, np.uint64), np.empty(0, np.int64), 10)
    texts = [pa.RecordBatch.from_arrays([pa.array([words, None, "one", words])], ["text"])]
    given = sum(b.column("words")[0].as_py() for turn in range(2) for b in pseudolikelihood._round(model, turn, 2)(iter(texts)))
    assert sum(batches) == given == 10_001


def test_a_step_of_learning_asks_for_little_memory():
    rng = np.random.default_rng(8)
    model = pseudolikelihood.begin(np.empty(0, np.uint64), np.empty(0, np.int64), 10)
    squares = {k: np.ones_like(v) for k, v in model.parts.items()}
    around, target = rng.integers(0, 300, (pseudolikelihood.BATCH, 4)), rng.integers(0, pseudolikelihood.PAD, pseudolikelihood.BATCH)
    pseudolikelihood.learn(model.parts, squares, around, target)
    pseudolikelihood.log_probabilities(model, around, target)
    tracemalloc.start()
    pseudolikelihood.learn(model.parts, squares, around, target)
    learnt = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pseudolikelihood.log_probabilities(model, around, target)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert learnt < 500_000 and scored < 500_000


@pytest.mark.parametrize("size", [1, 40, 400])
def test_single_precision_follows_double(size):
    rng = np.random.default_rng(9)
    model = pseudolikelihood.begin(np.empty(0, np.uint64), np.empty(0, np.int64), 10)
    model.parts["high"] *= size
    model.parts["low_bias"] += size * rng.standard_normal((64, 64)).astype(np.float32)
    double = pseudolikelihood.Model(model.hashes, model.numbers, {k: v.astype(np.float64) for k, v in model.parts.items()})
    around, target = rng.integers(0, pseudolikelihood.PAD + 1, (3000, 4)), rng.integers(0, pseudolikelihood.PAD, 3000)
    got, exact = (pseudolikelihood.log_probabilities(m, around, target) for m in (model, double))
    assert np.isfinite(got).all() and np.allclose(got, exact, rtol=1e-5, atol=2e-5)
    stepped = [{k: v.copy() for k, v in m.parts.items()} for m in (model, double)]
    for parts in stepped:
        pseudolikelihood.learn(parts, {k: np.ones_like(v) for k, v in parts.items()}, around[:1000], target[:1000])
    for name in stepped[0]:
        assert np.allclose(stepped[0][name], stepped[1][name], rtol=1e-3, atol=1e-3), name


def test_hashes_are_found():
    rng = np.random.default_rng(10)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.arange(9, dtype=np.uint64), ~np.arange(9, dtype=np.uint64)]))
    sought = np.concatenate([rng.permutation(hashes), hashes[-3:], rng.integers(0, 1 << 64, 3000, dtype=np.uint64)])
    for held in (hashes, hashes[:1], hashes[:0]):
        places, found = pseudolikelihood.Found(held)(sought)
        assert sorted(places.tolist()) == np.flatnonzero(np.isin(sought, held)).tolist()
        assert (held[found] == sought[places]).all()
