"""Toxic spans by a linear-chain conditional random field over two tags, clean and toxic.

Documents carry labels, words do not: a word of a toxic training document counts as toxic when its form, its front or its
tail is found in toxic documents much more often than chance allows. The field is trained on these tags. Marginals of the
forward-backward pass give offending spans, and their sums a document's score, set against the labels of documents that
the field was not trained on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
HASH_BITS = 18
SIGNIFICANT = 24.0
RATIO = 10.0
FORMS_KEPT = 400_000
CHARS_AT_ONCE = 1 << 18
WORDS_AT_ONCE = 100_000
_WORD = re.compile(r"\w+")
_STRIDE = 64


def features(word: str) -> list[str]:
    """What all words share, so that unknown ones have a score; the whole form; fronts of three to five characters; a tail of four."""
    word = word.lower()
    return ["", word, *("^" + word[:k] for k in (3, 4, 5) if len(word) > k), *([word[-4:] + "$"] if len(word) > 4 else [])]


def places(word: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS) for x in features(word)]


@dataclass
class Model:
    """``turn[i, j]`` is the score of tag j after i, ``begin[j]`` of tag j at the front, ``final`` of the document's sums."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << HASH_BITS, np.float32))
    turn: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(2))
    final: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))


def _forward(steps: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) M_0 ... M_t for every t, each scaled to sum 1; ``steps`` is n by 2 by 2.

    Blocks are multiplied out side by side and their products chained by the same function, so that the number of numpy
    calls grows with the logarithm of the length only.
    """
    n = len(steps)
    if n <= _STRIDE:
        out, now = np.empty((n, 2)), np.ones(2)
        for t in range(n):
            now = now @ steps[t]
            now /= now.sum()
            out[t] = now
        return out
    count = -(-n // _STRIDE)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (count * _STRIDE - n, 2, 2))]).reshape(count, _STRIDE, 2, 2)
    m00, m01, m10, m11 = (np.ascontiguousarray(padded[:, :, i, j].T) for i in (0, 1) for j in (0, 1))
    p = np.empty((4, _STRIDE, count))
    p[:, 0] = m00[0], m01[0], m10[0], m11[0]
    for t in range(1, _STRIDE):
        a, b, c, d = p[:, t - 1]
        p[0, t], p[1, t] = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t]
        p[2, t], p[3, t] = c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        p[:, t] /= p[:, t].sum(0)
    ends = _forward(p[:, -1].T.reshape(count, 2, 2))
    front = np.vstack([np.full((1, 2), 0.5), ends[:-1]])
    out = np.stack([front[:, 0] * p[0] + front[:, 1] * p[2], front[:, 0] * p[1] + front[:, 1] * p[3]], -1)
    out = out.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def _steps(emissions: np.ndarray, heads: np.ndarray, model: Model) -> np.ndarray:
    """One matrix per word. At a document's head both rows are alike: what came before it does not count."""
    steps = np.broadcast_to(np.exp(model.turn), (len(emissions), 2, 2)).copy()
    steps[heads] = np.exp(model.begin)
    steps[:, :, 1] *= np.exp(np.clip(emissions, -30, 30))[:, None]
    return steps


def marginals(emissions: np.ndarray, heads: np.ndarray, model: Model, pairs: bool = False):
    """Probability of the toxic tag per word of documents laid end to end; with ``pairs`` also of each pair of tags in a row."""
    if not len(emissions):
        return np.empty(0), np.zeros((0, 2, 2))
    steps = _steps(emissions, heads, model)
    left = _forward(steps)
    right = np.ones((len(steps), 2))
    if len(steps) > 1:
        right[:-1] = _forward(steps[:0:-1].transpose(0, 2, 1))[::-1]
    both = left * right
    toxic = both[:, 1] / both.sum(1)
    if not pairs:
        return toxic, None
    before = np.vstack([np.ones((1, 2)), left[:-1]])
    joint = before[:, :, None] * steps * right[:, None, :]
    return toxic, joint / joint.sum((1, 2), keepdims=True)


def summed(toxic: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document (ending at ``ends``): a constant, log of the expected toxic words, log odds of the likeliest."""
    n = np.diff(np.concatenate([[0], ends]))
    out = np.tile([1.0, np.log(1e-6), np.log(1e-6)], (len(ends), 1))
    full = n > 0
    if full.any():
        heads = (ends - n)[full]
        top = np.clip(np.maximum.reduceat(toxic, heads), 1e-6, 1 - 1e-6)
        out[full, 1] = np.log(np.add.reduceat(toxic, heads) + 1e-6)
        out[full, 2] = np.log(top / (1 - top))
    return out


@dataclass
class _Forms:
    """The word forms of a sample: those of each document by number, and each form's features as ``spot[heads[k]:heads[k + 1]]``."""

    docs: list[np.ndarray]
    heads: np.ndarray
    spot: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> _Forms:
        numbers: dict[str, int] = {}
        docs = [np.array([numbers.setdefault(w, len(numbers)) for w in _WORD.findall(t)], np.int32) for t in texts]
        lists = [places(w) for w in numbers]
        sizes = np.array([len(x) for x in lists], np.int64)
        return cls(docs, np.concatenate([[0], np.cumsum(sizes)]), np.array([p for x in lists for p in x], np.int32), np.repeat(np.arange(len(lists), dtype=np.int32), sizes))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.spot], len(self.heads) - 1)

    def marked(self, flags: np.ndarray) -> np.ndarray:
        """Forms with a flagged feature."""
        return np.bincount(self.owner, flags[self.spot], len(self.heads) - 1) > 0


def _standing_out(forms: _Forms, chosen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Flags of features that toxic documents have much more often than chance allows."""
    seen = np.zeros((2, 1 << HASH_BITS))
    for k in chosen:
        own = np.unique(forms.docs[k])
        seen[int(labels[k])][np.unique(np.concatenate([forms.spot[forms.heads[w] : forms.heads[w + 1]] for w in own]) if len(own) else [])] += 1
    clean, toxic = (max(1, int((labels[chosen] == y).sum())) for y in (0, 1))
    chance = toxic / (toxic + clean)
    outside, inside = seen
    both = np.maximum(inside + outside, 1)
    gain = 2 * (inside * np.log(np.maximum(inside, 1) / (both * chance)) + outside * np.log(np.maximum(outside, 1) / (both * (1 - chance))))
    return (gain >= SIGNIFICANT) & (inside > 0) & (inside / toxic >= RATIO * (outside / clean))


def _logistic(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, its first column a constant, by Newton steps."""
    weight, ridge = np.zeros(x.shape[1]), np.diag([0.0, *[0.05] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        weight = weight - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(weight)), x.T @ (p - target) + ridge @ weight)
    return weight


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 20) -> Model:
    """``share`` is the part of toxic documents among all labelled ones, which the sample may not keep.

    Three of four documents train the field by gradient steps over all their words; the rest sets the weights of the score.
    """
    model = Model()
    if not len(texts) or labels.min() == labels.max():
        model.final = np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0, 0.0])
        return model
    forms = _Forms.of(texts)
    ids = forms.docs
    held = np.arange(len(ids)) % 4 == 3
    train = [k for k in np.flatnonzero(~held) if len(ids[k])]
    if train:
        tag_of = forms.marked(_standing_out(forms, np.array(train), labels))
        groups, size = [[]], 0
        for k in train:  # whole documents, about WORDS_AT_ONCE words together
            if size >= WORDS_AT_ONCE:
                groups.append([])
                size = 0
            groups[-1].append(k)
            size += len(ids[k])
        parts, pair, first = [], np.zeros((2, 2)), np.zeros(2)
        for group in groups:
            word, lengths = np.concatenate([ids[k] for k in group]), [len(ids[k]) for k in group]
            heads = np.cumsum([0, *lengths])[:-1]
            y = tag_of[word] & np.repeat(labels[group] == 1, lengths)
            later = np.ones(len(word), bool)
            later[heads] = False
            pair += np.bincount((2 * np.concatenate([[0], y[:-1]]) + y)[later], minlength=4).reshape(2, 2)
            first += np.bincount(y[heads].astype(int), minlength=2)
            parts.append((word, heads, y, later))
        squares = [np.zeros(len(model.weights)), np.zeros((2, 2)), np.zeros(2)]
        for _ in range(rounds):
            scores, by_form = forms.scores(model.weights), np.zeros(len(forms.heads) - 1)
            turn, begin = -pair, -first
            for word, heads, y, later in parts:
                toxic, joint = marginals(scores[word], heads, model, pairs=True)
                by_form += np.bincount(word, toxic - y, len(by_form))
                turn = turn + joint[later].sum(0)
                begin = begin + np.array([(1 - toxic[heads]).sum(), toxic[heads].sum()])
            slopes = [np.bincount(forms.spot, by_form[forms.owner], len(model.weights)) + 0.05 * model.weights, turn, begin]
            for square, slope, part in zip(squares, slopes, (model.weights, model.turn, model.begin), strict=True):
                square += slope**2
                part -= (0.5 * slope / (np.sqrt(square) + 1e-6)).astype(part.dtype)
    scores = forms.scores(model.weights)
    sums = np.vstack([summed(marginals(scores[ids[k]], np.array([0]), model)[0] if len(ids[k]) else np.empty(0), np.array([len(ids[k])])) for k in np.flatnonzero(held)])
    target = labels[held].astype(float)
    if 0 < target.mean() < 1:
        used, weight = [0, 1, 2], np.zeros(3)
        while True:
            found = _logistic(sums[:, used], target)
            if (found[1:] >= 0).all():
                break
            del used[1 + int(found[1:].argmin())]  # more signs of toxicity may not speak against it
        weight[used] = found
        weight[0] += np.log(share / (1 - share)) - np.log(target.mean() / (1 - target.mean()))
        model.final = weight
    else:
        model.final = np.array([-3.0, 1.0, 0.0])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample_rows`` labelled documents of each class, chosen by a hash of the key, of at most
    ``sample_chars`` characters each. Of several labels of one document the largest counts; null labels and keys do not.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    total = dict(rows.groupBy("y").count().collect())
    if not total:
        return Model()
    # Two classes of bounded size, so small enough to send everywhere.
    chosen = None
    for y in sorted(total):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= sample_chars).join(F.broadcast(chosen), "k")
    found = sorted((tuple(r) for r in texts.select("k", "t", "y").limit(2 * sample_rows).collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return fit([t for _, t, _ in found], np.array([y for *_, y in found]), total.get(1, 0) / sum(total.values()))


def tag(text: Column, model: Model) -> Column:
    """``struct<score double, spans array<struct<start int, end int, marginal double>>>``, offsets in code points.

    A span is a run of words whose toxic marginal is one half or more, with the largest of them. Null texts are empty.
    """
    known: dict[str, float] = {}
    weights: list[float] = []

    def emission(word: str) -> float:
        if len(known) > FORMS_KEPT:
            known.clear()
        value = known[word] = sum([weights[p] for p in places(word)])
        return value

    def spans(content: str, toxic: np.ndarray) -> list[dict]:
        out: list[dict] = []
        last = -2
        for k, (m, p) in enumerate(zip(_WORD.finditer(content), toxic.tolist(), strict=True)):
            if p >= 0.5:
                if out and last == k - 1:
                    out[-1] = {"start": out[-1]["start"], "end": m.end(), "marginal": max(p, out[-1]["marginal"])}
                else:
                    out.append({"start": m.start(), "end": m.end(), "marginal": p})
                last = k
        return out

    def scored(texts: pa.Array) -> pa.Array:
        if not weights:
            weights.extend(model.weights.tolist())
        scores: list[float] = []
        found: list[list[dict]] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < CHARS_AT_ONCE):
                group.append(texts[at].as_py() or "")
                size += len(group[-1])
                at += 1
            emitted, ends = [], []
            for content in group:
                emitted += [known[w] if w in known else emission(w) for w in _WORD.findall(content)]
                ends.append(len(emitted))
            ends = np.array(ends)
            heads = np.concatenate([[0], ends[:-1]])
            toxic, _ = marginals(np.array(emitted), heads[heads < ends], model)
            logit = summed(toxic, ends) @ model.final
            scores += (1 / (1 + np.exp(-np.clip(logit, -60, 60)))).tolist()
            over = np.concatenate([[0], np.cumsum(toxic >= 0.5)])
            found += [spans(c, toxic[a:b]) if over[b] > over[a] else [] for c, a, b in zip(group, heads.tolist(), ends.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], ["score", "spans"])

    return F.arrow_udf(scored, "score double, spans array<struct<start: int, end: int, marginal: double>>")(text)
