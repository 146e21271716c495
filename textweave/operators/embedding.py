"""Sentence vectors from an encoder that the caller gives; no model is shipped or loaded here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences that an encoder gets at once.
BATCH = 32


def mean_pooling(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of token vectors (batch, tokens, dim) where the mask is 1; none of them gives zeros."""
    m = mask[:, :, None].astype(tokens.dtype)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def first_pooling(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The first token's vector."""
    return tokens[:, 0]


def l2_normalize(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def embed_sentences(sentences: DataFrame, text: str, load: Callable[[], Callable[[Sequence[str]], np.ndarray]], column: str = "embedding", prefix: str = "") -> DataFrame:
    """Adds a unit vector of each text. `load` runs once in each worker and gives the encoder (texts to rows of vectors).

    Texts go in batches of BATCH, after an optional prefix; a null text has a null vector.
    """
    schema = T.StructType([*sentences.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])
    at = sentences.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                texts = batch.column(at).to_pylist()
                some = [prefix + t for t in texts if t is not None]
                vectors = iter(l2_normalize(np.asarray(encode(some), np.float64)).astype(np.float32).tolist() if some else [])
                out = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], schema.names)

    return sentences.mapInArrow(run, schema)


#: Tokens that a model sees at once, its own marks included.
MAX_TOKENS = 512
#: Tokens, padding included, that a model gets in one call beyond its first text.
CALL_TOKENS = 32 * MAX_TOKENS


class TokenEncoder(NamedTuple):
    """A token model: texts to token ids (without marks), and (ids, mask), both (texts, tokens), to token vectors.

    `begin` and `end` are the marks put around each window; they are seen by the model and pooled like other tokens.
    """

    ids: Callable[[Sequence[str]], list[Sequence[int]]]
    forward: Callable[[np.ndarray, np.ndarray], np.ndarray]
    begin: tuple[int, ...] = ()
    end: tuple[int, ...] = ()
    pad: int = 0


def pooled_windows(windows: list[Sequence[int]], encoder: TokenEncoder, pooling: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """A unit vector for each window of ids, in the order given. Windows of like length share a call, so little is padded."""
    out: list[np.ndarray] = [np.empty(0)] * len(windows)
    order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
    while order:
        width = len(windows[order[-1]]) + len(encoder.begin) + len(encoder.end)
        n = min(len(order), max(1, CALL_TOKENS // max(1, width)))
        call, order = order[-n:], order[:-n]
        ids, mask = np.full((n, width), encoder.pad, np.int64), np.zeros((n, width), np.int64)
        for row, k in enumerate(call):
            whole = [*encoder.begin, *windows[k], *encoder.end]
            ids[row, : len(whole)], mask[row, : len(whole)] = whole, 1
        for k, v in zip(call, l2_normalize(np.asarray(pooling(encoder.forward(ids, mask), mask), np.float64)), strict=True):
            out[k] = v
    return out


def embed_windows(texts: DataFrame, text: str, load: Callable[[], TokenEncoder], most: int = MAX_TOKENS, pooling: str = "mean", beyond: str = "windows", prefix: str = "", window: str = "window", size: str = "n_tokens", column: str = "embedding") -> DataFrame:
    """The rows with (window, n_tokens, embedding): a pooled unit vector of each window of at most `most` tokens, marks included.

    A text that is longer is covered whole by consecutive windows, a row each; with beyond="cut" its first window stands for
    it alone, as a sentence encoder truncates. A text without a token has one window, of the marks alone, and a null vector
    where there are no marks either; a null text one row with nulls. `load` runs once in each worker. Pooling: "mean" over
    the tokens or "first".
    """
    pool = {"mean": mean_pooling, "first": first_pooling}[pooling]
    if beyond not in ("windows", "cut"):
        raise ValueError(f"beyond must be windows or cut, not {beyond}")
    clash = {window, size, column} & set(texts.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already: name the new ones otherwise")
    schema = T.StructType([*texts.schema.fields, T.StructField(window, T.IntegerType()), T.StructField(size, T.IntegerType()), T.StructField(column, T.ArrayType(T.FloatType()))])
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        step = most - len(encoder.begin) - len(encoder.end)
        if step < 1:
            raise ValueError("a window has no room for a token")
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                held = batch.column(at).to_pylist()
                some = [prefix + t for t in held if t is not None]
                found = iter(encoder.ids(some) if some else [])
                rows: list[tuple[int, int | None, Sequence[int] | None]] = []
                for k, t in enumerate(held):
                    if t is None:
                        rows.append((k, None, None))
                        continue
                    ids = next(found)
                    ends = range(0, max(1, len(ids)), step)
                    rows += [(k, j, ids[b : b + step]) for j, b in enumerate(ends[:1] if beyond == "cut" else ends)]
                marks = len(encoder.begin) + len(encoder.end)
                seen = [r[2] for r in rows if r[2] is not None and len(r[2]) + marks]
                vectors = iter(pooled_windows(seen, encoder, pool))
                cells = [None if ids is None or not len(ids) + marks else next(vectors).astype(np.float32) for _, _, ids in rows]
                sizes = [None if ids is None else len(ids) for _, _, ids in rows]
                kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([r[1] for r in rows], pa.int32()), pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.float32()))], schema.names
                )

    return texts.mapInArrow(run, schema)


def word_encoder(dim: int = 8) -> Callable[[], TokenEncoder]:
    """A token model without weights, for tests and dry runs: a word's id comes from its length and first character, a token's
    vector from residues of its id."""

    def load() -> TokenEncoder:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        steps = np.arange(dim) * 2 + 3

        def ids(texts: Sequence[str]) -> list[list[int]]:
            return [[len(w) * 1000 + ord(w[0]) for w in word.findall(t)] for t in texts]

        return TokenEncoder(ids, lambda i, mask: (i[:, :, None] * steps % 97) / 97.0)

    return load


#: Letters whose shares make up a profile, in eight groups of like frequency.
PROFILE = ("e", "tz", "ao", "in", "sr", "hlv", "dcum", "bfgjkpqwxy")


def letter_profile(text: Column) -> Column:
    """A unit vector from the counts of letters in eight groups: an encoder without a model, for tests and dry runs.

    A text without any of the letters has the zero vector.
    """
    low = F.lower(text)
    counts = F.array(*[(F.length(low) - F.length(F.regexp_replace(low, f"[{g}]", ""))).cast("double") for g in PROFILE])
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))
