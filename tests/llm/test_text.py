"""Word arrays, components and byte-level BPE."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from csvharbor.llm import bpe, components, textarrays
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é \t\n\x0b1z", max_size=40)), max_size=8)


@given(TEXTS, st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_and_shingles_of_blocks(texts, size):
    found, sets = [], []
    for block in textarrays.blocks(pa.array(texts, pa.string()), size):
        w = textarrays.words(block)
        found += [[bytes(block.data[a:b]).decode() for a, b, r in zip(w.starts, w.ends, w.rows) if r == k] for k in range(len(w.counts))]
        sets += [len(x) for x in textarrays.shingles(textarrays.word_hashes(block, w), w, 3)]
    assert found == [brute.words(t, lower=False) for t in texts]
    assert sets == [len(brute.shingle_set(t, 3)) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (block,) = textarrays.blocks(pa.array(["one two", "x  Two\tONE one"]))
    w = textarrays.words(block)
    one, two, x, upper_two, upper_one, last = textarrays.word_hashes(block, w).tolist()
    assert one == upper_one == last and two == upper_two and len({one, two, x}) == 3


def test_sliced_arrays():
    (block,) = textarrays.blocks(pa.array(["left out", None, "a b", "c"]).slice(1, 2))
    assert bytes(block.data) == b"a b" and block.bounds.tolist() == [0, 0, 3]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(25)] + [(200, 201 + k) for k in range(30)]
    union = brute.Union()
    for a, b in links:
        if a != b:
            union.join(a, b)
    got = components.components(spark.createDataFrame(links + links[:5] + [(None, 3)], "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == {x: union.find(x) for x in union.up}


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


@given(st.text(alphabet=st.sampled_from("ab'st 12\n\t!?éß漢  "), max_size=300), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_give_the_ids_of_the_whole(text, size):
    whole = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN).encode_ordinary(text)
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode_text(text, size=size) == whole


def test_bpe_columns(spark):
    long = "word and more 123 " * 20_000
    texts = [None, "", "plain text", "Ünïcode 漢字 \U0001f600", long, "x" * 150_000, "same", "same"]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = rows.select("doc_id", bpe.encode(F.col("text")).alias("e"), bpe.round_trip(F.col("text")).alias("r")).withColumn("d", bpe.decode(F.col("e")))
    tokens = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    for r in coded.collect():
        assert r.e == r.r.ids == tokens.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.d) == bytes(r.r.decoded) == (texts[r.doc_id] or "").encode()


def test_ids_cut_anywhere_decode(spark):
    ids = bpe.encode_text("漢字\U0001f600")
    rows = spark.createDataFrame([(ids[:k],) for k in range(len(ids) + 1)] + [(None,)], "ids array<int>")
    tokens = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    got = [r.b for r in rows.select(bpe.decode(F.col("ids")).alias("b")).collect()]
    assert [b and bytes(b) or b"" for b in got] == [tokens.decode_bytes(ids[:k]) for k in range(len(ids) + 1)] + [b""]


def test_mix_is_a_bijection_on_a_sample():
    assert len(np.unique(textarrays.mix(np.arange(100_000, dtype=np.uint64)))) == 100_000


def test_bpe_results_leave_in_small_parts(spark):
    texts = [None, "", "Ünïcode 漢字 \U0001f600", "word and more 123 " * 20_000, "same", "same", *["some text " * 1_000] * 40]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tokens = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.round_trips(rows).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        assert got[k].ids == tokens.encode_ordinary(text or "") and bytes(got[k].decoded) == (text or "").encode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = list(bpe._in_blocks("text", bpe.RANKS, public_tokenizers.PATTERN, 50_000)(iter([batch])))
    assert [r for part in made for r in part.column(0).to_pylist()] == list(range(len(texts)))
    assert len(made) > 9 and sorted(part.nbytes for part in made)[-2] < 150_000  # but for the long text
