"""Quick ways to exact marks: batch candidates, white space, words and checks against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textweave.functions import candidates as cd
from textweave.functions import generated, segments
from textweave.functions import text as tx
from textweave.operators import discourse, quality

SPACES = [chr(c) for c in (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
TEXTS = ["", " ", "a", "éa\u00a0b. C?\u3000d!\u2028\u2029e", "a\r\r\nb\r\n\tc  \t d\n \nE", "x..." + "\nÉt y:\nNo.\n\n\nWord one.\nTwo", *[f"{c}a{c}{c}b.{c}C{c}" for c in SPACES], "\u200ba\u200b b", "😀 😀. 😀"]
ODD = ["But then i mean it", "éthen later", "laterß, now", "i've learned that. wait,", "wait,x", "…", "a — b -- c", "So the run", "an ate", "xing", "wxing é", "beded", "WHO KNOWS", "t\u0301hen", "then\u0301", "then_", "(then)", "a\nso", "!!!", "??", "the read", "bread reads", ""]


def one(spark, texts, of):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(of(F.col("t")).alias("x")).collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_words_and_sentences(spark):
    inside = "".join(SPACES) + "".join(chr(c) for c in range(0x2000, 0x200B))
    plain = lambda t: re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t)).strip(inside)
    assert set(tx.WS_CHARS) == set(inside)
    assert one(spark, TEXTS, tx.normalize_text) == [plain(t) for t in TEXTS]
    assert one(spark, TEXTS, tx.word_count) == [len(re.findall(f"[^{inside}]+", t)) for t in TEXTS]
    assert one(spark, TEXTS, tx.sentences) == [[p for p in (x.strip(inside) for x in re.split(f"(?<=[.!?])[{inside}]+", t)) if p] for t in TEXTS]


def test_segmentation_has_no_pattern_at_every_place(spark):
    """white space is stripped and line ends are joined without patterns; a pattern begins with what is rare."""
    d = spark.createDataFrame([("a\nB",)], "t string")
    assert "RegExpReplace" not in plan_of(d.select(tx.strip(F.col("t"))))
    plan = plan_of(d.select(segments.all_sentences(F.col("t")))).lower()
    assert "regexp_replace(x" not in plan and "(?<=\\.\\.\\.|" not in plan


@pytest.mark.parametrize("name", list(discourse.PHRASES))
def test_candidates_are_no_narrower(spark, name):
    """every sentence with a mark is a candidate for it, and only candidates meet the exact patterns."""
    phrases = discourse.PHRASES[name]
    texts = [t.lower() for t in (*ODD, *phrases[:20], *(f"é {p}, b" for p in phrases[:20]), *(f"x{p}" for p in phrases[:5]))]
    d = spark.createDataFrame([(texts,)], "s array<string>").select("s", cd.candidates(F.col("s"), list(discourse.WORDING_CANDIDATES.values())).alias("k"))
    k = list(discourse.WORDING_CANDIDATES).index(name)
    for r in d.select(F.explode(F.arrays_zip("s", "k")).alias("z")).select("z.s", cd.may(F.col("z.k"), k).alias("may"), discourse.has_phrase(F.col("z.s"), phrases).alias("has")).collect():
        word = lambda c: c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"
        want = any(not (m.start() and word(r.s[m.start() - 1])) and not word(r.s[m.end() : m.end() + 1] or " ") for p in phrases for m in re.finditer(f"(?={re.escape(p)})", r.s) for m in [re.compile(re.escape(p)).match(r.s, m.start())])
        assert r.has == want and r.may >= r.has


def test_marks_by_words(spark):
    """Verbs as before: suffixes on words of enough letters, base verbs not after an article."""
    old = r"(?U)\b(?:" + discourse.VERBS + r"|\w{2,}(?:ed|ing|es))\b", r"(?U)(?<!\bthe\s)(?<!\ba\s)(?<!\ban\s)\b" + discourse.alternation(discourse.lx.BASE_VERBS) + r"\b"
    texts = [t.lower() for t in ODD]
    assert one(spark, texts, discourse.has_verb) == one(spark, texts, lambda t: t.rlike(old[0]) | t.rlike(old[1]))


def test_checks_lower_a_text_once(spark):
    """the checks take a lower-case column, and patterns stand behind what they need."""
    texts = ["a@b.co", "A@b", "call 555-123-4567", "12 Long Street", "12 long street.", "MES", "mesa", "the coherence  score", "a Language Model", "Scoring!", "x" * 60, None]
    assert one(spark, texts, generated.disallowed) == [True, False, True, True, True, True, False, False, True, True, False, None]
    d = spark.createDataFrame([("a",)], "t string").withColumn("low", F.lower("t"))
    assert plan_of(d.select(generated.valid_entry(F.col("t"), F.col("low")), generated.disallowed(F.col("t"), F.col("low")))).count("lower(t") == 1


def test_markup_behind_hints(spark):
    """markup residue is found as by its patterns alone; its hints stand before them."""
    texts = ["<b>", "ALT=", "href=x", "&AMP;", "Take the\nquiz", "Take the QUıZ", "quiz result", "HTTPS://a", "xhttp://", "WwW.a", r"\u00e9", "a: b", "queue", "w w.", "1 < 2", ""]
    assert one(spark, texts, tx.corrupted) == one(spark, texts, lambda t: t.rlike("(?iU)" + tx.CORRUPTION))
    assert "://|[qQ]" in plan_of(quality.markers(spark.createDataFrame([(1, "a")], "doc_id int, text string")))


def test_scored_texts_read_stored_sentences(spark):
    """segmentation and vectors are worked out once and not again by every family of features."""
    from textweave.plans import records

    assert "split(" not in plan_of(records.scored_texts(spark, "/root/testdata/sf0.001"))


def test_disorder_finds_names_at_word_starts(spark):
    """F16: names are sought by their capital, not by a word boundary at every place, with the same results."""
    texts = ["Anna met Bob", "éAnna Über Carl", "AnNa", "Dan1 Eve_ Fay", "(Gus) Hal's", "", "Ian.Jo Kim"]
    old, new = r"(?U)\b[A-Z][a-z]{2,}\b", r"(?U)[A-Z](?<=\b[A-Z])[a-z]{2,}\b"
    assert one(spark, texts, lambda t: F.regexp_extract_all(t, F.lit(new), F.lit(0))) == one(spark, texts, lambda t: F.regexp_extract_all(t, F.lit(old), F.lit(0)))
    plan = plan_of(discourse.disorder(spark.createDataFrame([(1, ["a"])], "doc_id int, sentences array<string>")))
    assert "[A-Z](?<=" in plan and old not in plan
