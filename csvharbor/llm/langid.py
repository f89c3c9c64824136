"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte n-grams tells on which side of the bit's
split a text lies. Decoding adds up, per language, the logistic loss of every bit and takes the least.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.textarrays import blocks

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 12
SAMPLE_ROWS = 3000
UNKNOWN = "und"
_ROWS_AT_ONCE = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass(frozen=True)
class Model:
    """``codes`` has -1 and 1, a row per language; ``weights`` a column per bit, the last row for the bias."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    margin: float


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """All splits of up to 6 classes; for more, the random code of 10 log2(classes) bits with the largest least distance."""
    if classes <= 6:
        splits = range(1, 1 << (classes - 1)) if classes > 1 else range(0)
        return np.array([[1 if split >> k & 1 else -1 for split in splits] for k in range(classes)], np.float64).reshape(classes, len(splits))
    rng, bits, best = np.random.default_rng(seed), math.ceil(10 * math.log2(classes)), (-1, np.empty(0))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        apart = bits - code @ code.T
        best = max(best, (float(apart[~np.eye(classes, dtype=bool)].min()), code), key=lambda x: x[0])
    return best[1]


def profiles(texts: pa.Array):
    """For parts of the texts in order: hashed n-gram profiles, a row per text. Each order's part has length 1 (or 0).

    Letters A-Z count as a-z, other ASCII as blanks; n-grams are of UTF-8 bytes.
    """
    each = BUCKETS // len(ORDERS)
    for block in blocks(texts):
        for top in range(0, block.last - block.first, _ROWS_AT_ONCE):
            bounds = block.bounds[top : top + _ROWS_AT_ONCE + 1]
            data = _FOLD[block.data[bounds[0] : bounds[-1]]].astype(np.uint32)
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            out = np.zeros((len(bounds) - 1, len(ORDERS), each), np.float32)
            grams = np.zeros(len(data), np.uint32)
            for k, order in enumerate(ORDERS):
                n = max(0, len(data) - order + 1)
                grams = grams[:n] * np.uint32(257) + data[order - 1 :]
                spread = grams * np.uint32(0x9E3779B1)
                spread ^= spread >> np.uint32(15)
                spread *= np.uint32(0x85EBCA77)
                place = (spread >> np.uint32(8)) % np.uint32(each)
                inside = rows[:n] == rows[order - 1 :]
                counts = np.bincount((rows[:n] * each + place)[inside], minlength=len(out) * each).reshape(len(out), each)
                out[:, k] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
            yield out.reshape(len(out), -1)


def fit(rows: list[tuple[str, np.ndarray]], margin: float = math.log(3), steps: int = 300, decay: float = 1e-4) -> Model:
    """One logistic classifier per bit, over profiles with their language, by gradient steps with momentum on all rows."""
    languages = tuple(sorted({language for language, _ in rows}))
    codes = codewords(len(languages))
    if not codes.size:
        return Model(languages, codes, np.zeros((BUCKETS + 1, 0), np.float32), margin)
    x = np.array([profile for _, profile in rows], np.float32)
    at = np.searchsorted(languages, [language for language, _ in rows])
    y = codes[at].astype(np.float32)
    share = np.bincount(at, minlength=len(languages))
    each = (1 / (len(languages) * share[at])).astype(np.float32)[:, None]
    weights = np.zeros((BUCKETS + 1, codes.shape[1]), np.float32)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        slope = -y * each / (1 + np.exp(np.clip(y * (x @ weights[:-1] + weights[-1]), -30, 30)))
        step = np.vstack([x.T @ slope, slope.sum(0)]) + decay * weights
        speed = 0.9 * speed + step
        weights -= 5 * speed
    return Model(languages, codes, weights, margin)


def train(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most about ``sample_rows`` rows that have a language and a letter, as many of each language as there are.

    Only the profiles of these rows, of fixed size, reach the driver. The choice goes by a hash of ``key``.
    """
    known = docs.where(F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(language).alias("language"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("draw")
    )
    counts = docs.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("language")).count().collect()
    if not counts:
        return fit([])
    quota = max(1, sample_rows // len(counts))
    limits = F.create_map(*(F.lit(x) for row in counts for x in (row["language"], min(1 << 30, (quota << 30) // row["count"]))))
    drawn = known.where(F.col("draw") < limits[F.col("language")]).select("language", "text")

    def profiled(batches):
        for batch in batches:
            parts = [part.astype(np.float16) for part in profiles(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for part in parts for row in part], pa.binary())], ["language", "profile"])

    found = drawn.mapInArrow(profiled, "language string, profile binary").collect()
    found.sort(key=lambda row: (row["language"], bytes(row["profile"])))
    return fit([(row["language"], np.frombuffer(row["profile"], np.float16)) for row in found])


def predict(text: Column, model: Model) -> Column:
    """``struct<lang string, score double, ambiguous boolean>``.

    ``score`` is the chosen language's share when every language counts with exp(-loss); ``ambiguous`` says that the next
    codeword's loss is within the model's margin. Texts that are null or without a letter are ``und`` with score 0.
    """

    def decode(texts: pa.Array) -> pa.Array:
        best, score, close = [], [], []
        for part in profiles(texts):
            side = part @ model.weights[:-1] + model.weights[-1]
            loss = np.logaddexp(0, -side[:, None, :] * model.codes[None]).sum(2)
            share = np.exp(loss.min(1, keepdims=True) - loss)
            two = np.sort(loss, 1)[:, :2]
            best += loss.argmin(1).tolist()
            score += (1 / share.sum(1)).tolist()
            close += (two[:, -1] - two[:, 0] < model.margin).tolist() if len(model.languages) > 1 else [False] * len(part)
        names = pa.array([model.languages[k] for k in best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["lang", "score", "ambiguous"])

    kind = "lang string, score double, ambiguous boolean"
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if not model.languages:
        return unknown
    found = F.arrow_udf(decode, kind)(text)
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), found).otherwise(unknown)
