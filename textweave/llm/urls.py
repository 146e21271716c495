"""URL filter by a path-template tree, in DataFrame functions alone.

Per host, paths are split into segments and variable parts of a segment (numbers, long hexadecimal) become wildcards. Going
down the tree, a segment becomes a wildcard as a whole where a branch has very many children. Sibling branches merge where
neither a chi-square test of what follows them nor a two-proportion test of their labels tells them from the rest.
Explicit rules label the pages they fit; a template is rejected when its labelled block share, smoothed towards the share
of the host's pages that is labelled so, is above a threshold.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import stored

#: Verdict and rule (host, then path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MANY_CHILDREN = 50
#: One-sided 5 % for shapes, two-sided 5 % for labels.
Z_SHAPE, Z_LABEL = 1.645, 1.96
PRIOR_WEIGHT, REJECT = 4.0, 0.5
#: Distinct shapes up to which the judged tree is broadcast: 32 bytes each.
BROADCAST_SHAPES = 500_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEXADECIMAL, DIGITS, LETTERS = "[0-9a-fA-F-]{12,}", "[0-9]+", r"\p{L}+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, CAPITALS.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent domain and the start of the path, as a (verdict, rule) struct."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """Variable parts as wildcards: hexadecimal of 12 or more, then runs of digits."""
    return F.regexp_replace(F.regexp_replace(segment, HEXADECIMAL, "*"), DIGITS, "*")


def form(text: Column) -> Column:
    """What a text looks like: runs of letters as `a`, wildcards as they are."""
    return F.regexp_replace(text, LETTERS, "a")


def shapes_of(path: Column) -> Column:
    """The shapes of all segments."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)


def template_tree(pages: DataFrame) -> DataFrame:
    """Distinct (host, shapes) of pages (host, shapes, label) with counts, and the template after generalising and merging.

    Goes down a level at a time until no path has a further segment. Tables of shapes are aggregated before every join. A template has `*` for a segment of very many values and `~` for
    merged branches.
    """
    tree = pages.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.count("label").alias("n_lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_bad"))
    tree = stored(tree.withColumn("template", F.lit("")), "shapes")
    node = ["host", "template"]
    for k in itertools.count():
        if not tree.where(F.size("shapes") > k).limit(1).count():
            return tree
        here = tree.withColumn("segment", F.get("shapes", F.lit(k))).where("segment IS NOT NULL")
        rest = form(F.array_join(F.slice("shapes", k + 2, 1 << 30), "/"))
        # Whether nothing follows or an empty segment does is part of what follows.
        cells = here.withColumn("rest", F.concat((F.size("shapes") > k + 1).cast("string"), rest)).groupBy(*node, "segment", "rest").agg(*(F.sum(c).alias(c) for c in ("n", "n_lab", "n_bad")))
        columns = cells.groupBy(*node, "rest").agg(F.sum("n").alias("n_rest"))
        branches = cells.join(columns, [*node, "rest"]).groupBy(*node, "segment").agg(
            F.sum("n").alias("n"), F.sum("n_lab").alias("lab"), F.sum("n_bad").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n") / F.col("n_rest")).alias("fit")
        )
        parents = branches.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("p_n"), F.sum("lab").alias("p_lab"), F.sum("bad").alias("p_bad"))
        kinds = columns.groupBy(*node).agg((F.count("*") - 1).cast("double").alias("free"))
        seen = branches.join(parents.join(kinds, node), node)
        n, whole = F.col("n").cast("double"), F.col("p_n").cast("double")
        apart = F.try_divide(whole * whole, n * (whole - n)) * (F.col("fit") - n * n / whole)
        ninth = F.try_divide(F.lit(2.0), 9 * F.col("free"))
        most = F.col("free") * F.pow(1 - ninth + Z_SHAPE * F.sqrt(ninth), 3)
        alike = (F.col("children") > 1) & ((F.col("free") == 0) | F.coalesce(apart <= most, F.lit(False)))
        share = F.try_divide("p_bad", "p_lab")
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("lab")) + F.try_divide(F.lit(1.0), F.col("p_lab") - F.col("lab"))))
        gap = F.abs(F.try_divide("bad", "lab") - F.try_divide(F.col("p_bad") - F.col("bad"), F.col("p_lab") - F.col("lab")))
        alike &= F.coalesce(gap <= Z_LABEL * error, F.lit(True))  # without a label on either side only shapes count
        name = F.when(F.col("children") > MANY_CHILDREN, "*").when(alike, "~").otherwise(F.col("segment"))
        named = seen.select(*node, "segment", F.concat("template", F.lit("/"), name).alias("next"))
        longer = here.join(named, [*node, "segment"]).select("host", "shapes", "n", "n_lab", "n_bad", F.col("next").alias("template"))
        ended = tree.where(F.size("shapes") <= k).select("host", "shapes", "n", "n_lab", "n_bad", "template")
        tree = stored(longer.unionByName(ended), "shapes")


def judged_tree(tree: DataFrame) -> DataFrame:
    """(host, shapes, template, purity): labelled block shares of templates, smoothed towards the host's, those towards all."""
    everything = tree.agg(F.sum("n_bad").alias("bad"), F.sum("n").alias("n")).first()
    base = everything.bad / everything.n if everything.n else 0.0
    hosts = tree.groupBy("host").agg(((F.sum("n_bad") + PRIOR_WEIGHT * base) / (F.sum("n") + PRIOR_WEIGHT)).alias("prior"))
    templates = tree.groupBy("host", "template").agg(F.sum("n_lab").alias("lab"), F.sum("n_bad").alias("bad"))
    pure = templates.join(hosts, "host").select("host", "template", ((F.col("bad") + PRIOR_WEIGHT * F.col("prior")) / (F.col("lab") + PRIOR_WEIGHT)).alias("purity"))
    return tree.select("host", "template", "shapes").join(pure, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, purity) for every row; other columns are ignored.

    A null url, or one without `://`, has an empty host and path and is allowed unless a template says otherwise. A rule's
    verdict stands over the method's. Equal urls get equal verdicts; null ids and repeated rows are kept; no rows give none.
    Pages meet their template by 128 bits of hashes, broadcast while the shapes are few enough.
    """
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    host, path = split_url(F.col("url"))
    found = source.select("page_id", host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    labelled = found.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"), shapes_of(F.col("path")).alias("shapes"))
    tree = template_tree(labelled.select("host", "shapes", (F.col("ruled") == "block").cast("long").alias("label")))
    key = [F.xxhash64("host", "shapes").alias("_a"), F.xxhash64("shapes", "host", F.lit(1)).alias("_b")]
    judged = judged_tree(tree).select(*key, "purity")
    if tree.count() <= BROADCAST_SHAPES:
        judged = F.broadcast(judged)
    verdict = F.coalesce("ruled", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    return labelled.select("*", *key).join(judged, ["_a", "_b"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "purity")
