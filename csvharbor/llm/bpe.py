"""Byte-level BPE encoding and decoding with a rank file that every machine has.

Each match of the pre-splitting pattern is encoded alone, without special tokens. Every alternative of the pattern takes
white space only at its front or as a run, and none looks back, so a place between a solid character and white space is
always a border between two matches. Long texts are cut there before they are encoded; the ids are those of the whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.llm.textarrays import BLOCK_BYTES, blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_CHARS = 1 << 16
_BORDER = regex.compile(r"(?<=\S)\s")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """The text in parts of about ``size`` characters, cut at borders only; a longer run without white space stays whole."""
    at = 0
    while len(text) - at > size and (border := _BORDER.search(text, at + size)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def encode_text(text: str, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = PIECE_CHARS) -> list[int]:
    tokens = encoding(ranks, pattern)
    if len(text) <= size:
        return tokens.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in tokens.encode_ordinary(piece)]


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encode(text: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text column, ``array<int>``. Null and empty texts have none."""

    def ids(texts: pa.Array) -> pa.Array:
        return _id_lists([np.array(encode_text(t.as_py() or "", ranks, pattern), np.int32) for t in texts])

    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The raw bytes behind a column of token ids, null for null. No UTF-8 check is made: ids cut anywhere decode as well."""

    def raw(lists: pa.Array) -> pa.Array:
        tokens = encoding(ranks, pattern)
        return pa.array([None if x is None else tokens.decode_bytes(x) for x in lists.to_pylist()], pa.binary())

    return F.arrow_udf(raw, "binary")(ids)


def round_trip(text: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """``struct<ids array<int>, decoded binary>``: the ids and what they decode to, with one encoding of each text."""

    def both(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_both(texts, ranks, pattern), ["ids", "decoded"])

    return F.arrow_udf(both, "ids array<int>, decoded binary")(text)


def _both(texts: pa.Array, ranks: str, pattern: str) -> list[pa.Array]:
    tokens = encoding(ranks, pattern)
    found, decoded = [], []
    for text in texts:  # one text's ids as Python numbers at a time
        ids = encode_text(text.as_py() or "", ranks, pattern)
        found.append(np.array(ids, np.int32))
        decoded.append(tokens.decode_bytes(ids))
    return [_id_lists(found), pa.array(decoded, pa.binary())]


def _in_blocks(text: str, ranks: str, pattern: str, size: int):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c != text]
            texts = batch.column(text)
            for block in blocks(texts, size):
                part = slice(block.first, block.last)
                made = _both(texts[part], ranks, pattern)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[part] for c in others), *made], [*others, "ids", "decoded"])

    return coded


def round_trips(docs: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = BLOCK_BYTES) -> DataFrame:
    """The rows without ``text``, with ``ids`` and ``decoded`` as by ``round_trip``; other columns have other names.

    Results leave a task for every ``size`` bytes of text, or a longer text, and not for every Arrow batch, whose rows may be
    long: neither side holds the ids and bytes of more.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), *made])
    return docs.mapInArrow(_in_blocks(text, ranks, pattern, size), schema)
