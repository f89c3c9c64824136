"""Masked pseudo-likelihood of documents under a small bidirectional window network.

Every word is predicted from the words on both sides of it, itself masked. The vocabulary is counted over all documents. The
most frequent words have numbers of their own; the others share some, and each has its share of its number by its own count.
Training passes over all documents too: in each round every task starts from the same parameters, learns from the words that
the round masks in its part of the corpus, and the results are averaged by the number of words. The rounds mask different
words of each text, by their places in it, and together every word once.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.textarrays import Block, blocks, mix, word_hashes, words
from csvharbor.session import cut

SIDE = 64  # a word's number has a high and a low digit of this base
KNOWN = 3584
SPREAD = SIDE * SIDE - KNOWN  # numbers for all other words, by hash
PAD = SIDE * SIDE
WINDOW = 2
WIDTH = 16
HIDDEN = 48
ROUNDS = 2
BATCH = 1024
POSITIONS = 1024
COMMON = 400_000  # words whose counts the scorer holds, 16 bytes each
REACH = 100  # of scores to base 2, so that sums of their powers stay within single precision
_STEP = "floor(8 * log2(n))"  # of counts: few values, and in their order

_LOG2_E = float(np.log2(np.e))
_ROUNDS_OFF = float(3 << 22)  # added to a small single, it leaves the nearest whole number in the low bits
# 2**x from -1/2 to 1/2 times a factor: a polynomial with first coefficient 1, from the second on, and the factor
_POWER = (5.842975253307482, 25.103962004425178, 72.42575846781776, 104.49202934356423)
_POWER_FACTOR = 1 / 0.009570100874752619

_SHAPES = {
    "embed": (PAD + 1, WIDTH), "inner": (2 * WINDOW * WIDTH, HIDDEN), "inner_bias": (HIDDEN,),
    "high": (HIDDEN, SIDE), "high_bias": (SIDE,), "low": (HIDDEN, SIDE), "low_bias": (SIDE, SIDE),
}


class Found:
    """Finds hashes among ``hashes``, which are in order, by their first bits: a search by halves takes four times as long."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.unused = np.uint64(64 - max(16, len(hashes).bit_length()))

    @cached_property
    def index(self) -> tuple[np.ndarray, int]:
        """Where the hashes with the same first bits begin, and how many have them at most; made where it is used."""
        sizes = np.bincount((self.hashes >> self.unused).astype(np.int64), minlength=1 << (64 - int(self.unused)))
        return (np.cumsum(sizes) - sizes).astype(np.int32), int(sizes.max())

    def __call__(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``sought`` of those found, and where each stands in ``hashes``."""
        firsts, most = self.index
        at, places, found = np.take(firsts, (sought >> self.unused).astype(np.int64)), [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for _ in range(most):
            places.append(np.flatnonzero(np.take(self.hashes, at, mode="clip") == sought))
            found.append(at[places[-1]])
            at += 1
        found = np.minimum(np.concatenate(found), len(self.hashes) - 1)
        return np.concatenate(places), found


@dataclass
class Model:
    """Hashes of the known words in order, the number of each, the network's parameters, and how often the other words of each
    shared number stand in the corpus."""

    hashes: np.ndarray
    numbers: np.ndarray
    parts: dict[str, np.ndarray]
    masses: np.ndarray = field(default_factory=lambda: np.zeros(SPREAD))

    @cached_property
    def found(self) -> Found:
        return Found(self.hashes)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[name].ravel() for name in _SHAPES])

    def replaced(self, values: np.ndarray) -> Model:
        cuts = np.cumsum([int(np.prod(shape)) for shape in _SHAPES.values()])[:-1]
        pieces = zip(_SHAPES.items(), np.split(values.astype(np.float32), cuts), strict=True)
        return Model(self.hashes, self.numbers, {name: piece.reshape(shape).copy() for (name, shape), piece in pieces}, self.masses)


def begin(hashes: np.ndarray, counts: np.ndarray, total: int, seed: int = 3, masses: np.ndarray | None = None) -> Model:
    """The untrained model: it gives every word its share in the corpus. ``hashes`` come with the most frequent first.

    Without ``masses`` the words that are not among them count as spread evenly over the shared numbers.
    """
    masses = np.full(SPREAD, max(0, total - counts.sum()) / SPREAD) if masses is None else masses
    order = np.argsort(hashes)
    rng = np.random.default_rng(seed)
    mass = np.ones(SIDE * SIDE)
    mass[: len(counts)] += counts
    mass[KNOWN:] += masses
    share = mass.reshape(SIDE, SIDE)
    parts = {name: (rng.standard_normal(shape) * (0.3 if name == "embed" else 0.1)).astype(np.float32) for name, shape in _SHAPES.items()}
    parts["inner_bias"] = np.zeros(HIDDEN, np.float32)
    parts["high_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    parts["low_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return Model(hashes[order], order, parts, masses)


def _shared(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(SPREAD)).astype(np.int64)


def numbered(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the block its number, row and hash; and the words of each row."""
    found = words(block)
    hashes = word_hashes(block, found)
    out = KNOWN + _shared(hashes)
    known, places = model.found(hashes)
    out[known] = np.take(model.numbers, places)
    return out, found.rows, hashes, found.counts


def contexts(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers around each word, left to right without itself; PAD beyond the text."""
    out = np.full((len(numbers), 2 * WINDOW), PAD, np.uint16)
    for column, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        to, back = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        same = rows[to] == rows[back]
        out[to, column] = np.where(same, numbers[back], PAD)
    return out


class _Room(threading.local):
    """Arrays that are used again from step to step: new ones of this size come from the system page by page, which took a
    sixth of the time of learning. What a function returns in one holds until the next call."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, int], kind: np.dtype) -> np.ndarray:
        size = shape[0] * shape[1]
        if name not in self.kept or self.kept[name].size < size or self.kept[name].dtype != kind:
            self.kept[name] = np.empty(size, kind)
        return self.kept[name][:size].reshape(shape)


_room = _Room()


@dataclass
class _Outer:
    """The layer behind the hidden values for scores to base 2, both digits side by side, and whether scores may be beyond
    ``REACH``. The biases are a row per high digit."""

    weights: np.ndarray
    biases: np.ndarray
    wide: bool


def _outer(parts: dict[str, np.ndarray]) -> _Outer:
    weights = np.concatenate([parts["high"], parts["low"]], 1) * _LOG2_E
    biases = np.empty((SIDE, 2 * SIDE), weights.dtype)
    biases[:, :SIDE], biases[:, SIDE:] = parts["high_bias"], parts["low_bias"]
    biases *= _LOG2_E
    reach = np.abs(weights).sum(0).max() + np.abs(biases).max()  # hidden values are within 1
    return _Outer(weights, biases, not reach < REACH)


def _hidden(parts: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and hidden values, a row per word."""
    kind = parts["embed"].dtype
    x = np.take(parts["embed"], around.ravel(), axis=0, out=_room("x", (around.size, WIDTH), kind), mode="clip").reshape(len(around), -1)
    h = np.matmul(x, parts["inner"], out=_room("h", (len(around), HIDDEN), kind))
    h += parts["inner_bias"]
    return x, np.tanh(h, out=h)


def _scores(h: np.ndarray, outer: _Outer, digits: np.ndarray) -> np.ndarray:
    """From hidden values the scores to base 2 of the high and then the low digit, a row per word."""
    y = np.matmul(h, outer.weights, out=_room("y", (len(h), 2 * SIDE), h.dtype))
    y += np.take(outer.biases, digits, axis=0, out=_room("first", y.shape, h.dtype), mode="clip")
    if outer.wide:
        y.reshape(-1, 2, SIDE)[:] -= y.reshape(-1, 2, SIDE).max(2, keepdims=True)
    return y


def _sums(y: np.ndarray) -> np.ndarray:
    """Of both digits of each word."""
    return (y.reshape(-1, SIDE) @ np.ones(SIDE, y.dtype)).reshape(-1, 2)


def _powers(y: np.ndarray, wide: bool = False) -> float:
    """Puts 2 to the power of each in its place, times a factor; returns the factor.

    Single precision, where all must be within 120, or below it if ``wide``: whole powers by shifting bits, the rest by a
    polynomial that is right to 3 parts in a million.
    """
    if y.dtype != np.float32:
        np.exp2(y, out=y)
        return 1.0
    if wide:
        np.maximum(y, -REACH, out=y)
    whole, rest = _room("first", y.shape, y.dtype), _room("second", y.shape, y.dtype)
    np.add(y, _ROUNDS_OFF, out=whole)
    np.subtract(whole, _ROUNDS_OFF, out=rest)
    np.subtract(y, rest, out=rest)
    bits = np.left_shift(whole.view(np.int32), 23, out=whole.view(np.int32))
    np.add(rest, _POWER[0], out=y)
    for coefficient in _POWER[1:]:
        np.multiply(y, rest, out=y)
        np.add(y, coefficient, out=y)
    np.add(y.view(np.int32), bits, out=y.view(np.int32))
    return _POWER_FACTOR


def log_probabilities(model: Model, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = np.empty(len(target))
    outer = _outer(model.parts)
    for at in range(0, len(target), POSITIONS):
        part = slice(at, at + POSITIONS)
        digits = target[part] // SIDE
        n = np.arange(len(digits))
        y = _scores(_hidden(model.parts, around[part])[1], outer, digits)
        value = y[n, digits].astype(np.float64) + y[n, SIDE + target[part] % SIDE]
        factor = _powers(y, outer.wide)
        out[part] = value / _LOG2_E - np.log(_sums(y).astype(np.float64) / factor).sum(1)
    return out


def learn(parts: dict[str, np.ndarray], squares: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, rate: float = 0.1) -> None:
    """One step on a batch, with a step size per parameter that falls as its slopes add up."""
    order = np.argsort((target // SIDE).astype(np.uint8), kind="stable")  # words of a high digit stand together
    around, target = around[order], target[order]
    digits, n = target // SIDE, np.arange(len(target))
    outer = _outer(parts)
    x, h = _hidden(parts, around)
    y = _scores(h, outer, digits)
    _powers(y, outer.wide)
    shares = y.reshape(-1, 2, SIDE)
    shares *= (1 / _sums(y))[:, :, None]
    y[n, digits] -= 1
    y[n, SIDE + target % SIDE] -= 1
    d_pre = np.matmul(y, outer.weights.T, out=_room("d_pre", h.shape, h.dtype))
    bend = np.multiply(h, h, out=_room("first", h.shape, h.dtype))
    np.subtract(1, bend, out=bend)
    bend *= 1 / _LOG2_E  # the layer's weights are to base 2
    d_pre *= bend
    words, embed = _summed(around.ravel(), np.matmul(d_pre, parts["inner"].T, out=_room("second", x.shape, x.dtype)).reshape(-1, WIDTH))
    heads, every = _heads(digits), slice(None)
    outward = h.T @ y
    slopes = {
        "embed": (words, embed), "inner": (every, x.T @ d_pre), "inner_bias": (every, d_pre.sum(0)), "high": (every, outward[:, :SIDE]),
        "high_bias": (every, y[:, :SIDE].sum(0)), "low": (every, outward[:, SIDE:]), "low_bias": (digits[heads], _runs(y[:, SIDE:], heads)),
    }
    for name, (rows, slope) in slopes.items():
        square = squares[name][rows]
        square += slope * slope
        if rows is not every:
            squares[name][rows] = square
        parts[name][rows] -= rate * slope / np.sqrt(square)


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _runs(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sums of the rows from each head to the next, two columns at a time."""
    return np.add.reduceat(values.view(np.result_type(values.dtype, np.complex64)), heads).view(values.dtype)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of the values of each."""
    rows = rows.astype(np.uint16)  # sorted by digits
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    heads = _heads(ordered)
    values = np.take(values, order, axis=0, out=_room("first", values.shape, values.dtype), mode="clip")
    return ordered[heads].astype(np.int64), _runs(values, heads)


def masked(rows: np.ndarray, counts: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Which words the round predicts: by their places in their texts, whatever texts stand beside them."""
    places = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    return mix(places.astype(np.uint64) + np.uint64(1)) % np.uint64(rounds) == turn


def _round(model: Model, turn: int, rounds: int):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.replaced(model.flat())
        squares = {name: np.full(shape, 1.0, np.float32) for name, shape in _SHAPES.items()}
        done, held, size = 0, [], 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                numbers, rows, _, counts = numbered(block, model)
                own_turn = masked(rows, counts, turn, rounds)
                held.append((contexts(numbers, rows)[own_turn], numbers[own_turn]))
                size += int(own_turn.sum())
                if size >= BATCH:
                    around, target = (np.concatenate(x) for x in zip(*held, strict=True))
                    for at in range(0, size - BATCH + 1, BATCH):
                        learn(own.parts, squares, around[at : at + BATCH], target[at : at + BATCH])
                    rest = size - size % BATCH
                    done, held, size = done + rest, [(around[rest:], target[rest:])], size % BATCH
        if size:
            learn(own.parts, squares, *(np.concatenate(x) for x in zip(*held, strict=True)))
        if done + size:
            values = own.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.float64) * (done + size)), pa.array(np.full(len(values), done + size, np.int64))],
                ["place", "value", "words"],
            )

    return trained


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_hashes(block, words(block)) for block in blocks(batch.column(0))]
        hashes, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``hash, n``: how often each word stands in all texts."""
    return cut(docs.select(text).mapInArrow(_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))


def _steps_of(counts: DataFrame) -> list[tuple[int, int]]:
    """Steps of the counts with their numbers of words, highest first: at most eight for each doubling."""
    return [tuple(r) for r in counts.groupBy(F.expr(_STEP).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()]


def common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and logarithms of the counts of at most ``COMMON`` of the most frequent words: whole steps of counts."""
    words, least = 0, None
    for step, size in _steps_of(counts.where("n > 1")):
        words += size
        if words > COMMON:
            break
        least = step
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    found = counts.where("n > 1").where(F.expr(_STEP) >= least).select("hash", "n").toArrow()
    hashes, n = found.column("hash").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.log(n[order])


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> Model:
    """A model of all texts; ``counts`` as by ``counted``. The driver gets the known words' counts, the masses of the shared
    numbers and averaged parameters, all of fixed size."""
    texts = docs.select(text)
    counts = counted(docs, text) if counts is None else counts
    words = 0
    for step, size in _steps_of(counts):  # only words that can be among the known ones are sorted
        words += size
        if words >= KNOWN:
            break
    top = counts.where(F.expr(_STEP) >= step).orderBy(F.desc("n"), "hash").limit(KNOWN).collect() if words else []
    hashes, often = np.array([r["hash"] for r in top], np.int64).astype(np.uint64), np.array([r["n"] for r in top], np.int64)
    masses = np.zeros(SPREAD)
    for r in counts.groupBy((F.shiftrightunsigned("hash", 40) % SPREAD).alias("k")).agg(F.sum("n").alias("n")).collect():
        masses[r["k"]] = r["n"]
    total = int(masses.sum())
    np.subtract.at(masses, _shared(hashes), often)
    model = begin(hashes, often, total, masses=masses)
    for turn in range(rounds):
        summed = texts.mapInArrow(_round(model, turn, rounds), "place int, value double, words long").groupBy("place").agg((F.sum("value") / F.sum("words")).alias("value"))
        rows = summed.collect()
        if rows:
            values = np.empty(len(rows))
            values[[r["place"] for r in rows]] = [r["value"] for r in rows]
            model = model.replaced(values)
    return model


def score(text: Column, model: Model, often: tuple[np.ndarray, np.ndarray] | None = None) -> Column:
    """``struct<words long, log_likelihood double>``: the sum over all words of the log-probability given both sides.

    A word without a number of its own has the share of a word that the corpus holds once, or not at all; ``likelihoods`` has
    the share by its count. With ``often``, as by ``common``, those it holds have it here too, and the hashes of the others
    are added, ``rare array<long>``. Null texts and texts without words have 0 words and sum 0.
    """
    once = np.log1p(model.masses)
    rare = often is not None
    held = Found(often[0]) if rare else None

    def scored(texts: pa.Array) -> pa.Array:
        n, sums, ends, others = [], [], [np.zeros(1, np.int64)], []
        for block in blocks(texts):
            numbers, rows, hashes, counts = numbered(block, model)
            values = log_probabilities(model, contexts(numbers, rows), numbers)
            shared = numbers >= KNOWN
            values[shared] -= once[numbers[shared] - KNOWN]
            n.append(counts)
            if rare:
                left, places = hashes[shared], np.flatnonzero(shared)
                known, place = held(left)
                values[places[known]] += np.take(often[1], place)
                others_only = np.ones(len(left), bool)
                others_only[known] = False
                left, places = left[others_only], places[others_only]
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(rows[places], minlength=len(counts))))
                others.append(left)
            sums.append(np.bincount(rows, values, len(counts)))
        full = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
        out = {"words": full(n, np.int64), "log_likelihood": full(sums, np.float64)}
        if rare:
            out["rare"] = pa.ListArray.from_arrays(full(ends, np.int32), full(others, np.int64))
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return F.arrow_udf(scored, "words long, log_likelihood double" + (", rare array<long>" if rare else ""))(text)


def likelihoods(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """The rows without ``text``, with ``words`` and ``log_likelihood``, every word by its own share of its number.

    The ``COMMON`` most frequent words are sent along with the network, so that no frequent word takes part in a join; the
    shares of all others come from a join with ``counts``. A word that is counted once has the share of one never seen,
    1 / (mass + 1), so only words counted more often are joined.
    """
    others = [c for c in docs.columns if c != text]
    found = cut(docs.select(F.struct(*others).alias("own"), F.monotonically_increasing_id().alias("row"), score(F.col(text), model, common(counts)).alias("f")))
    rare = found.select("row", F.explode("f.rare").alias("hash"))
    shares = rare.join(counts.where("n > 1"), "hash").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    summed = F.col("f.log_likelihood") + F.coalesce("more", F.lit(0.0))
    return found.join(shares, "row", "left").select(*(F.col("own")[c].alias(c) for c in others), F.col("f.words").alias("words"), summed.alias("log_likelihood"))
