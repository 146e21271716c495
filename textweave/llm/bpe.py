"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never be merged across, so each such pair marks a certain cut.
Pre-tokens are cut there, the fragments are encoded independently and their ids concatenated.
Merging runs on arrays: all fragments of a batch take their lowest-ranked merge in the same step.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textweave.llm.common import list_array, list_array_of, list_parts, ragged_take, string_bytes, sub_batches, texts_of, words_of

#: Above this many symbols a fragment is merged with a heap; the array steps are for the many short ones.
LONG_FRAGMENT = 64
NO_RANK = np.int32(2**31 - 1)
#: Chunks of these characters need no Unicode normalisation; letters are the Latin-1 ones, digits ASCII.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PLAIN_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def joined(strings: pa.Array) -> str:
    """All strings joined by newlines, without making a Python object of each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "\n")[0].as_py()


class PairTable:
    """Open-addressing hash table from symbol pairs to (rank, merged id), probed on whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, np.int32)
        self.into = np.zeros(1 << self.bits, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        for slot, key, (rank, into) in zip(self.slot(keys).tolist(), keys.tolist(), pairs.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.rank[slot], self.into[slot] = key, rank, into

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right
        slots = self.slot(keys)
        there = self.keys[slots]
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[rest]]
            rest = rest[(there != keys[rest]) & (there >= 0)]
        hit = self.keys[slots] == keys
        return np.where(hit, self.rank[slots], NO_RANK), self.into[slots]


class ForcedBoundaryBpe:
    """Encoder and decoder over a tokenizers file with a BPE model, an end-of-word suffix and no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge_of = {}
        for rank, (a, b) in enumerate(merges):
            self.merge_of.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.table = PairTable(self.merge_of)
        size = max([*vocab.values(), *self.specials.values()]) + 1
        names = [""] * size
        for name, i in [*vocab.items(), *self.specials.items()]:
            names[i] = name
        self.names = pa.array(names)
        self.inside = np.zeros((256, 256), bool)
        for name in vocab:
            body = [self.byte_of[c] for c in (name[: -len(self.suffix)] if name.endswith(self.suffix) else name) if c in self.byte_of]
            self.inside[body[:-1], body[1:]] = True

    def long_fragment(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost on ties, with a heap over a linked list."""
        n, at = len(symbols), list(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(found[0], i, at[i], at[i + 1], found[1]) for i in range(n - 1) if (found := self.merge_of.get((at[i], at[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue
            at[i], at[j], after[i] = into, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (found := self.merge_of.get((at[k], at[m]))):
                    heapq.heappush(heap, (found[0], k, at[k], at[m], found[1]))
        return [x for x in at if x >= 0]

    def fragments(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments (given by their first positions), and how many ids each has."""
        n = len(starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        done = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        long = np.flatnonzero(sizes > LONG_FRAGMENT)
        for f in long.tolist():
            ids = self.long_fragment(symbols[starts[f] : starts[f] + sizes[f]].tolist())
            done[0].append(np.full(len(ids), f))
            done[1].append(np.array(ids, np.int32))
        of = np.repeat(np.arange(n), sizes)
        if len(long):
            short = (sizes <= LONG_FRAGMENT)[of]
            symbols, of = symbols[short], of[short]
        rank = np.full(len(symbols), NO_RANK, np.int32)
        into = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], into[:-1] = self.table.find(symbols[:-1], symbols[1:])
            rank[:-1][of[:-1] != of[1:]] = NO_RANK
        symbols = symbols.copy()
        while len(symbols):
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(symbols)))
            active = best != NO_RANK
            if not active.all():
                over = ~np.repeat(active, sizes)
                done[0].append(of[over])
                done[1].append(symbols[over])
                keep = ~over
                symbols, of, rank, into, best, sizes = symbols[keep], of[keep], rank[keep], into[keep], best[active], sizes[active]
                if not len(symbols):
                    break
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            symbols, of, rank, into = symbols[keep], of[keep], rank[keep], into[keep]
            rank[at] = NO_RANK
            for i in (at, at - 1):
                i = i[(i >= 0) & (i < len(symbols) - 1)]
                i = i[of[i] == of[i + 1]]
                rank[i], into[i] = self.table.find(symbols[i], symbols[i + 1])
        of, ids = np.concatenate(done[0]), np.concatenate(done[1])
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)

    def pieces(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct pre-tokens, given as raw bytes."""
        raw, offsets = string_bytes(tokens)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(tokens) + 1, np.int64)
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        symbols = self.first[raw]
        symbols[ends] = self.last[raw[ends]]
        cut = np.append(True, ~self.inside[raw[:-1], raw[1:]])
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        ids, sizes = self.fragments(symbols, starts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        return ids, at[np.searchsorted(starts, offsets)]

    def encode_chunks(self, chunks: pa.Array, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct chunks free of ASCII white space."""
        n = len(chunks)
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        if self.specials:
            special = functools.reduce(np.logical_or, [pc.match_substring(chunks, s).to_numpy(zero_copy_only=False) for s in self.specials])
        else:
            special = np.zeros(n, bool)
        plain &= ~special
        where = np.flatnonzero(plain)
        found = PLAIN_PIECES.findall(joined(chunks.filter(pa.array(plain))).lower()) if len(where) else []
        found = pa.array(found, pa.string())
        ends = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        owner = where[np.cumsum(ends)[~ends]] if len(where) else np.zeros(0, np.int64)
        tokens = [found.filter(pa.array(~ends)).cast(pa.binary())]
        owners = [owner]
        odd_tokens, odd_owner, given = [], [], {}
        for i in np.flatnonzero(~plain).tolist():
            text = chunks[i].as_py()
            if special[i] and specials:
                given[i] = self.library.encode(text, add_special_tokens=False).ids
                continue
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                odd_tokens.append(bytes(map(self.byte_of.__getitem__, piece)))
                odd_owner.append(i)
        tokens.append(pa.array(odd_tokens, pa.binary()))
        owners.append(np.array(odd_owner, np.int64))
        coded = pa.concat_arrays(tokens).dictionary_encode()
        ids, offsets = self.pieces(coded.dictionary)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        flat, at = ragged_take(ids, offsets, codes)
        counts = np.bincount(owner[order], weights=np.diff(at), minlength=n).astype(np.int64)
        out = np.concatenate([[0], np.cumsum(counts)])
        if given:
            parts = [flat[out[i] : out[i + 1]] if i not in given else np.array(given[i], np.int32) for i in range(n)]
            flat, out = np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat.astype(np.int32), out

    def encode(self, texts: pa.Array, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of whole texts: the white-space chunks never share a pre-token."""
        codes, offsets, chunks = words_of(texts)
        ids, at = self.encode_chunks(chunks, specials)
        flat, ends = ragged_take(ids, at, codes)
        return flat, ends[offsets]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token texts joined by one space, as the library does for a file without a decoder."""
        flat, offsets = list_parts(ids)
        return pc.binary_join(list_array_of(self.names.take(flat), offsets), " ")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    """One encoder for each file and Python worker."""
    return ForcedBoundaryBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded string) for every row; other columns are ignored.

    Null or empty texts give empty ids and an empty decoded text; null ids, repeated rows and ties pass through row by row.
    An empty table gives an empty result. specials: special-token strings in a text become their ids, as in the library.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch in sub_batches(whole):
                ids = list_array(*bpe.encode(texts_of(batch), specials))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, bpe.decode(ids)], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
