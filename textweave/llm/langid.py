"""Language identification by multilingual mixture inference.

Words are the units that languages mix in. A word's likelihood under a language is that of its character n-grams;
expectation-maximisation over a document's words estimates the language proportions, and the set of languages is
the one of least penalised likelihood (-2 log L + k log n) among the nested sets of likeliest languages.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import ragged_take, sub_batches, texts_of, words_of

#: Hash buckets of n-grams: bounds the model at BUCKETS rows for each language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
STEPS = 6
#: Share of every word's likelihood spread evenly over the languages, so no single word decides.
FLOOR = 0.02
MAX_LANGUAGES = 256
#: Bytes of text whose n-grams are in memory at once.
READ_BYTES = 3 << 20


@functools.lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: n-gram buckets, the word of each, and whether a word has letters.

    Words are lower-cased; what is no letter is a break, as is the edge of a word.
    """
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().lower()
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32)
    owner = (np.cumsum(points == 10) - 1).astype(np.int32)  # an n-gram that starts on the break before a word is that word's
    letter = letters_table()[points]
    value = np.where(letter, points, 0).astype(np.uint64)
    buckets, owners = [], []
    for order in ORDERS:
        n = max(len(points) - order + 1, 0)
        gram = np.zeros(n, np.uint64)
        good = np.zeros(n, bool)
        for k in range(order):
            gram *= np.uint64(0x1F00D)
            gram += value[k : k + n]
            good |= letter[k : k + n]
        for k in range(1, order - 1):
            good &= letter[k : k + n]
        gram = gram[good] + np.uint64(order << 56)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        buckets.append((gram >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(owner[:n][good])
    found = np.zeros(len(words) + 1, bool)
    found[owner[letter]] = True
    return np.concatenate(buckets), np.concatenate(owners), found[:-1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Log-likelihoods of n-gram buckets for each language over all given rows with a text and a language.

    One row for each language and bucket reaches the driver: MAX_LANGUAGES * BUCKETS at most, checked.
    """
    source = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in sub_batches(whole, limit=READ_BYTES):
                codes, offsets, words = words_of(texts_of(batch))
                bucket, owner, _ = word_features(words)
                coded = batch.column(1).dictionary_encode()
                lang = coded.indices.to_numpy(zero_copy_only=False)
                of = np.repeat(lang, np.diff(offsets))
                for i, name in enumerate(coded.dictionary.to_pylist()):
                    times = np.bincount(codes[of == i], minlength=len(words))
                    counts = np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
                    total[name] = total[name] + counts if name in total else counts
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = source.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    if table.num_rows > MAX_LANGUAGES * BUCKETS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES")
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    where = {x: i for i, x in enumerate(names)}
    counts[table.column("bucket").to_numpy(), [where[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return {"languages": names, "log_p": np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32)}


def mixture(share: np.ndarray, likelihood: list[np.ndarray], of: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over all documents of a block: proportions and log-likelihood. Languages of share 0 stay out.

    likelihood: for each language, that of each word in the order of the documents; of: the document of each word.
    """
    n = len(share)
    count = np.maximum(np.bincount(of, minlength=n), 1)
    for _ in range(steps):
        weight = [share[:, k][of] * p for k, p in enumerate(likelihood)]
        total = np.maximum(functools.reduce(np.add, weight), 1e-30)
        share = np.stack([np.bincount(of, weights=w / total, minlength=n) / count for w in weight], 1)
    total = functools.reduce(np.add, [share[:, k][of] * p for k, p in enumerate(likelihood)])
    return share, np.bincount(of, weights=np.log(np.maximum(total, 1e-30)), minlength=n)


def infer(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index (-1: no letter), score, number of languages in the chosen set, for each text."""
    count = len(model["languages"])
    codes, offsets, words = words_of(texts)
    bucket, owner, letters = word_features(words) if len(words) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
    n = len(texts)
    best, score, size = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    if not count or not letters.any():
        return best, score, size
    logs = np.stack([np.bincount(owner, weights=by_bucket[bucket], minlength=len(words)) for by_bucket in model["log_p"].T], 1)
    likelihood = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -50))
    likelihood = (1 - FLOOR) * likelihood / likelihood.sum(1, keepdims=True) + FLOOR / count
    good = letters[codes]
    at = np.concatenate([[0], np.cumsum(good)])[offsets].astype(np.int64)
    codes = codes[good]
    m = np.diff(at)
    of = np.repeat(np.arange(n), m)
    by_word = [likelihood[:, k][codes] for k in range(count)]
    share, _ = mixture(np.full((n, count), 1 / count), by_word, of, STEPS)
    ranked = np.argsort(-share, axis=1, kind="stable")
    least = np.full(n, np.inf)
    chosen = share.copy()
    for k in range(1, count + 1):
        rows = np.flatnonzero((m > 0) & ((k <= 2) | (size == k - 1)))  # a set grows only while growing pays
        if not len(rows):
            break
        within = np.zeros((len(rows), count))
        np.put_along_axis(within, ranked[rows, :k], np.take_along_axis(share[rows], ranked[rows, :k], 1) + 1e-6, 1)
        within /= within.sum(1, keepdims=True)
        own, own_of = by_word, of
        if len(rows) < n:
            place, ends = ragged_take(np.arange(len(codes)), at, rows)
            own, own_of = [p[place] for p in by_word], np.repeat(np.arange(len(rows)), np.diff(ends))
        fitted, logs = mixture(within, own, own_of, 0 if k == 1 else STEPS)
        cost = -2 * logs + k * np.log(np.maximum(m[rows], 1))
        better = cost < least[rows]
        hit = rows[better]
        least[hit], size[hit] = cost[better], k
        chosen[hit] = fitted[better]
    found = m > 0
    best[found] = chosen[found].argmax(1)
    score[found] = np.clip(chosen[found].max(1), 0, 1)
    return best, score, size


def learning_fold(id_column: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_languages) for every row; nothing but the text is looked at.

    Null texts and texts without a letter give `und` and score 0, as does a model that learned no language. Ties go to
    the language first in alphabetical order. Null ids and repeated rows are judged row by row; no rows give none.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value["languages"], "und"])
        for whole in batches:
            for batch in sub_batches(whole, limit=READ_BYTES):
                best, score, size = infer(shared.value, texts_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score), pa.array(size.astype(np.int32))], ["doc_id", "lang_pred", "score", "n_languages"])

    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_languages", T.IntegerType())])
    return source.mapInArrow(run, schema)
