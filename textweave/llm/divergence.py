"""Source divergence audit: how far the term frequencies of the sources of a language lie apart, in whole numbers.

The sum over all kept terms for a pair of groups is split by how many groups have a term. Terms of many groups (heavy) are
dense tiles: a row of frequencies for each group, compared as numpy arrays. Terms of few groups (light) are sparse: a group
without the term has a frequency that depends on the group alone, so a pair's sum over light terms is that of two groups that
lack all of them, corrected for each count that either group has, and corrected again for each term that both have: only
these posting pairs are looked at. All parts are sums of whole numbers and are added as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.llm.common import list_parts, small_side, stored, string_bytes, sub_batches, texts_of
from textweave.operators.ordering import positions

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 10
#: Groups that a light term is in at most; terms of more are in tiles of TILE terms by BLOCK groups.
LIGHT, TILE, BLOCK = 8, 512, 256
SCALE = 1_000_000_000

#: Bytes of terms: A-Z as a-z, a-z and all of other characters as they are; all else is a space.
TABLE = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Dictionary codes of the terms of all texts, the offsets of texts, the distinct terms."""
    raw, offsets = string_bytes(texts)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(TABLE[raw]))
    flat, at = list_parts(pc.ascii_split_whitespace(clean))
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at]
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at.astype(np.int64), coded.dictionary


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) rows to (lang, source, term, n, docs) of a few megabytes of text each; term '' stands for the group."""
    for whole in batches:
        for batch in sub_batches(whole):
            codes, offsets, terms = terms_of(texts_of(batch))
            pairs = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["lang", "source"])
            names, group = np.unique(np.array([f"{x}\0{y}" for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], object), return_inverse=True)
            first = np.full(len(names), -1)
            first[group[::-1]] = np.arange(len(group))[::-1]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            width = max(1, len(terms))
            in_doc, times = np.unique(doc * width + codes, return_counts=True)
            cell, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            n, docs = np.bincount(at, times, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell)).astype(np.int64)
            zero = np.zeros(len(names), np.int64)
            rows = pairs.take(pa.array(first[np.concatenate([cell // width, np.arange(len(names))])]))
            term = pa.concat_arrays([terms.take(pa.array(cell % width)), pa.array([""] * len(names), pa.string())])
            yield pa.RecordBatch.from_arrays([rows.field(0), rows.field(1), term, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))], ["lang", "source", "term", "n", "docs"])


def frequency(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) in whole numbers; 1 where nothing is kept."""
    return F.coalesce(1 + F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(SCALE), F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(19,0)")), F.lit(1).cast("long"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare_tile(table: pa.Table) -> pa.Table:
    """(lang, tile, ga, gb) rows of groups with their frequencies in a tile to (lang, a, b, value) of each pair a < b.

    Rows have gid, base (frequency of a term that is not there), width (terms of the tile), and lists at and p of those there.
    """
    gid = table.column("gid").to_numpy()
    lists = table.column("at").combine_chunks(), table.column("p").combine_chunks()
    flat, offsets = list_parts(lists[0])
    values, _ = list_parts(lists[1])
    width = table.column("width")[0].as_py()
    dense = np.repeat(table.column("base").to_numpy()[:, None], width, 1)
    dense[np.repeat(np.arange(len(gid)), np.diff(offsets)), flat.to_numpy(zero_copy_only=False)] = values.to_numpy(zero_copy_only=False)
    blocks = gid // BLOCK
    ga, gb = table.column("ga")[0].as_py(), table.column("gb")[0].as_py()
    right = np.flatnonzero(blocks == gb)
    out = [[], [], []]
    for i in np.flatnonzero(blocks == ga):
        other = right[gid[right] > gid[i]]
        gap = dense[other] - dense[i]
        out[0].append(np.full(len(other), gid[i]))
        out[1].append(gid[other])
        out[2].append((gap * gap // (dense[other] + dense[i])).sum(1))
    a, b, value = (np.concatenate(o).astype(np.int64) for o in out)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": value})


def dense_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) over heavy terms, by tile and pair of blocks of groups."""
    heavy = postings.where("k IS NOT NULL").select("lang", "gid", F.expr(f"k div {TILE}").alias("tile"), F.struct(F.pmod("k", F.lit(TILE)).cast("int").alias("at"), "p").alias("e"))
    cells = heavy.groupBy("lang", "tile", "gid").agg(F.collect_list("e").alias("e"))  # at most TILE entries
    tiles = F.sequence(F.lit(0).cast("long"), F.expr(f"(n_heavy - 1) div {TILE}"))
    every = groups.where("n_heavy > 0").select("lang", "gid", "base", "n_heavy", "n_groups", F.explode(tiles).alias("tile"))
    rows = every.join(cells, ["lang", "tile", "gid"], "left").select(
        "lang", "tile", "gid", "base", F.least(F.lit(TILE), F.col("n_heavy") - F.col("tile") * TILE).cast("int").alias("width"), F.coalesce(F.col("e.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("e.p"), F.array().cast("array<bigint>")).alias("p"),
        F.expr(f"gid div {BLOCK}").alias("own"), F.expr(f"(n_groups - 1) div {BLOCK}").alias("last"),
    )
    partners = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda x: F.struct(F.least(x, F.col("own")).alias("ga"), F.greatest(x, F.col("own")).alias("gb")))
    spread = rows.select("*", F.explode(partners).alias("b")).select("lang", "tile", "b.*", "gid", "base", "width", "at", "p")
    return spread.groupBy("lang", "tile", "ga", "gb").applyInArrow(compare_tile, "lang string, a long, b long, value long")


def sparse_sums(postings: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, a, b, value) over light terms: the corrections for counts of one group, and for terms that both have."""
    light = postings.where("k IS NULL")
    side = lambda c: small_side(groups.select("lang", F.col("gid").alias(c), F.col("n_all").alias(f"n_{c}"), F.col("kept").alias(f"kept_{c}"), F.col("base").alias(f"base_{c}")), n_groups)
    p = lambda n, c: frequency(F.col(n), F.col(f"n_{c}"), F.col(f"kept_{c}"))
    a, b = F.col("base_a"), F.col("base_b")
    times = light.groupBy("lang", "gid", "n").agg(F.count("*").alias("m")).select("lang", F.col("gid").alias("a"), "n", "m")
    one = times.join(side("a"), ["lang", "a"]).join(side("b"), "lang").where("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (distance(p("n", "a"), b) - distance(a, b))).alias("value"))
    there = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "n"))).alias("e")).where(F.size("e") > 1)  # at most LIGHT entries
    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: y["gid"] > x["gid"]), lambda y: F.struct(x["gid"].alias("a"), y["gid"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))))
    met = there.select("lang", F.explode(pairs).alias("x")).select("lang", "x.*").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("m"))
    met = met.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumns({"pa": p("na", "a"), "pb": p("nb", "b")})
    two = met.select("lang", "a", "b", (F.col("m") * (distance(F.col("pa"), F.col("pb")) - distance(F.col("pa"), b) - distance(a, F.col("pb")) + distance(a, b))).alias("value"))
    return one.unionByName(two)


def audit(docs: DataFrame, least: int = LEAST_DOCS, light: int = LIGHT, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of a group to its language's other groups, and its `top` terms.

    Null text, language and source are ''. Repeated rows and ids are documents of their own. A group without terms is
    compared like others; a language without kept terms gives pairs of value 0. Languages of one source have no pairs; an empty
    table gives no rows. Other columns take no part.
    """
    read = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counts = read.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "term_counts")
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_term"), F.count("*").alias("groups")).where(F.col("docs") >= least).drop("docs")
    vocabulary = stored(vocabulary, "vocabulary")
    numbered = positions(vocabulary.where(F.col("groups") > light), ["lang"], ["term"], "k")
    words = vocabulary.where(F.col("groups") <= light).withColumn("k", F.lit(None).cast("long")).unionByName(numbered).drop("groups")
    found = stored(counts.where("term <> ''").drop("docs").join(words, ["lang", "term"]), "kept_terms")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_term").alias("n_lang"), F.count_if(F.col("groups") > light).alias("n_heavy"))
    groups = positions(counts.where("term = ''").select("lang", "source"), ["lang"], ["source"], "gid")
    groups = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("n_all")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.join(groups.groupBy("lang").agg(F.count("*").alias("n_groups")), "lang").fillna(0, ["n_all", "kept", "n_lang", "n_heavy"])
    groups = stored(groups.withColumn("base", frequency(F.lit(0), F.col("n_all"), F.col("kept"))), "groups")
    n_groups = groups.count()
    postings = found.join(small_side(groups.select("lang", "source", "gid", "n_all", "kept", "n_lang"), n_groups), ["lang", "source"])
    postings = stored(postings.withColumns({"p": frequency(F.col("n"), F.col("n_all"), F.col("kept")), "q": frequency(F.col("n_term"), F.col("n_lang"), F.col("kept"))}).select("lang", "source", "gid", "term", "n", "k", "p", "q"), "postings")

    own = lambda c, *more: groups.select("lang", F.col("gid").alias(c), F.col("source").alias(f"name_{c}"), F.col("base").alias(f"base_{c}"), *more)
    every = own("a", (F.col("kept") - F.col("n_heavy")).alias("n_light")).join(small_side(own("b"), n_groups), "lang").where("a < b")
    absent = every.select("lang", "a", "b", (F.col("n_light") * distance(F.col("base_a"), F.col("base_b"))).alias("value"))
    sums = absent.unionByName(dense_sums(postings, groups)).unionByName(sparse_sums(postings, groups, n_groups)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))).alias("x")
    named = sums.select("lang", both, "value").select("lang", "x.*", "value")
    name = lambda c, to: small_side(groups.select("lang", F.col("gid").alias(c), F.col("source").alias(to)), n_groups)
    pairs = named.join(name("g", "source"), ["lang", "g"]).join(name("o", "item"), ["lang", "o"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))
