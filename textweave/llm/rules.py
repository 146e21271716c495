"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit for each rule. A policy is a named,
versioned mask over those bits: applying another policy or computing ablations needs bitwise operations on the ledger
alone, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import list_parts, mix64, segment_sum, string_bytes, sub_batches, texts_of, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = "#*$%&|<>"

#: Bit, name, SQL predicate over the measurements that is true on failure. Bits never change their meaning.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "2 * n_symbols > n_words"),
    (3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 25 * n_words"),
]

#: Policy and version to the rules that it enforces.
POLICIES: dict[str, list[str]] = {
    "base@1": ["few_words", "repeated_words"],
    "quality@1": ["few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"],
    # Without the rules of word length, which turn away scripts that put no spaces between words.
    "quality@2": ["few_words", "repeated_words", "symbols", "repeated_lines"],
}


def policy_mask(policy: str) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def window_codes(a: np.ndarray, b: np.ndarray, c: np.ndarray, n_words: int) -> np.ndarray:
    """A number for each triple of word codes, equal for equal triples alone, however many words there are."""
    bits = max(1, int(n_words - 1).bit_length())
    if 3 * bits > 64:  # pairs are numbered first: there are no more of them than windows
        a, bits = np.unique(a * n_words + b, return_inverse=True)[1], 32
        return (a.astype(np.uint64) << np.uint64(bits)) | c.astype(np.uint64)
    shift = np.uint64(bits)
    return (((a.astype(np.uint64) << shift) | b.astype(np.uint64)) << shift) | c.astype(np.uint64)


def repeated_words(codes: np.ndarray, offsets: np.ndarray, n_words: int) -> np.ndarray:
    """For each text, the words inside 3-word windows that the text holds twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(of[:-2] == of[2:])
        window = window_codes(codes[at], codes[at + 1], codes[at + 2], n_words)
        key = mix64(window ^ mix64(of[at].astype(np.uint64)))
        order = np.argsort(key)
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (window[a] == window[b]) & (of[at[a]] == of[at[b]])
        twice = np.zeros(len(at), bool)
        twice[a[same]] = True
        twice[b[same]] = True
        begin = at[twice]
        for k in range(3):
            covered[begin + k] = True
    return segment_sum(covered, offsets)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    codes, offsets, words = words_of(texts)
    raw, at = string_bytes(texts)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    begins = np.ones(256, bool)
    begins[0x80:0xC0] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    lines, line_at = list_parts(pc.split_pattern(texts, "\n"))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), np.diff(line_at))[full]
    line = lines.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(of, minlength=len(texts))
    distinct = np.bincount(np.unique((of << 32) | line) >> 32, minlength=len(texts))
    return {
        "n_words": np.diff(offsets),
        "word_chars": segment_sum((begins & ~space)[raw], at),
        "n_symbols": segment_sum(symbol[raw], at),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated_words(codes, offsets, len(words)),
        "n_lines": n_lines,
    }


def fail_bits() -> Column:
    out = F.lit(0).cast("long")
    for bit, _, predicate in RULES:
        out = out.bitwiseOR(F.when(F.expr(predicate), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits) for every row; other columns are ignored.

    A null text counts as having no words. Null ids and repeated rows are judged row by row; no rows give none.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                found = measure(texts_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return source.mapInArrow(run, schema).withColumn("fail_bits", fail_bits())


def apply_policy(entries: DataFrame, policy: str = "quality@1") -> DataFrame:
    """Adds `kept`: no enforced rule failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = "quality@1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger collapses to one row for each distinct mask (2 ** rules at most) before the rules are compared.
    """
    mask = policy_mask(policy)
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    enforced = [(bit, name) for bit, name, _ in RULES if mask >> bit & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name in enforced)))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("bits_seen"),
    )


def judged(entries: DataFrame, policies: dict[str, str], ablated: str = "quality@1") -> DataFrame:
    """The ledger with a verdict for each {column: policy}, and what ablation says of each row under the policy `ablated`:
    `deciding_rule`, the one rule that alone rejects the row (null if none or several do), and `n_deciding`, how many rows of
    the ledger that rule alone rejects, so how many more a policy without it keeps.

    Everything comes from the bits. Give a stored ledger: it is read twice, the texts are not. The ablations that meet the
    rows are one row a rule.
    """
    mask = policy_mask(ablated)
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask))
    rule = F.coalesce(*(F.when(alone == 1 << bit, F.lit(name)) for bit, name, _ in RULES if mask >> bit & 1))
    out = entries.withColumns({c: F.col("fail_bits").bitwiseAND(F.lit(policy_mask(p))) == 0 for c, p in policies.items()} | {"deciding_rule": rule})
    found = ablations(entries, ablated).select(F.col("rule").alias("deciding_rule"), F.col("n_only_this").alias("n_deciding"))
    return out.join(F.broadcast(found), "deciding_rule", "left")
