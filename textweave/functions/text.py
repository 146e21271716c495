"""Text normalisation, segmentation and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweave.functions.lexicons import CORRUPTION


#: Unicode white space as the inside of a character class, alike in Java's and RE2's patterns.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Frequent characters that are not white space: tried first, they spare the ranges of WS.
SEEN = r"!-~\x{a1}-\x{24f}"
#: The characters of WS.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(WS_CHARS))


def normalize_text(t: Column) -> Column:
    """Line ends as \\n, runs of spaces and tabs as one space, ends stripped of Unicode white space; newlines kept."""
    lines = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.replace(lines, F.lit("\t"), F.lit(" ")), "  +", " "))


def sentences(t: Column) -> Column:
    """Pieces after `.`, `!` or `?` and white space, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(t, rf"[\W&&[{WS}]](?<=[.!?][{WS}])[{WS}]*"), strip), lambda x: x != "")


def punctuation_only(t: Column) -> Column:
    return t.rlike(rf"^[{WS}\p{{P}}]*$")


def word_tokens(t: Column) -> Column:
    """Word-character runs, case kept."""
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0))


def letter_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(r"[a-z']+"), F.lit(0))


def opening(t: Column, n: int = 5) -> Column:
    """The first n lower-case letter tokens, joined."""
    return F.array_join(F.slice(letter_tokens(t), 1, n), " ")


def paragraphs(t: Column) -> Column:
    return F.size(F.filter(F.split(t, rf"\n[{WS}]*\n"), lambda x: ~x.rlike(f"^[{WS}]*$")))


def has_bullets(t: Column) -> Column:
    return t.rlike(rf"(?m)^[{WS}]*[-*•][{WS}]+")


def word_count(t: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(t, F.lit(f"[{SEEN}[^{WS}]]+"))


def em_dashes(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit("—")))


def corrupted(t: Column) -> Column:
    """Markup residue: tags, attributes, entities, links, quiz remains, escapes."""
    hints = t.rlike(r"[<=&\\]|://|[qQ](?iU:uiz)|[wW](?iU:ww\.)")  # every pattern holds one of them; most texts none
    return hints & t.rlike("(?iU)" + CORRUPTION)


def looping(w: Column) -> Column:
    """Six tokens or more with an adjacent repeat, a pair that follows itself, or a token of over three letters thrice."""
    n = F.size(w)
    at = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    same = lambda i, k: F.coalesce(F.get(w, i) == F.get(w, i + k), F.lit(False))
    repeats = F.exists(at, lambda i: same(i, 1) | (same(i, 2) & same(i + 1, 2)))
    long = F.sort_array(F.filter(w, lambda x: F.length(x) > 3))
    m = F.size(long)
    thrice = F.exists(F.zip_with(F.slice(long, 1, F.greatest(m - 2, F.lit(0))), F.slice(long, 3, F.greatest(m - 2, F.lit(0))), lambda a, b: a == b), lambda x: x)
    return (n >= 6) & (repeats | thrice)


#: Powers of two whose sum is 2 * 10^digits.
_TWICE = {0: (2,), 1: (16, 4), 2: (128, 64, 8)}


def fixed(x: Column, digits: int, sign: bool = False) -> Column:
    """A number with none to two places as C and Python print it: by its exact value, halves to even. Java's formatter would
    round the shortest digits half up.

    Whether the number is above the middle between two prints is told by differences that are exact near it.
    """
    a = F.abs(x.cast("double"))
    n = F.floor(F.least(a, F.lit(1e12)) * 10**digits)
    above = a * _TWICE[digits][0] - (2 * n + 1).cast("double")
    for part in _TWICE[digits][1:]:
        above = above + a * part
    n = n + F.when((above > 0) | ((above == 0) & (n % 2 == 1)), 1).otherwise(0)
    text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), "0")
    if digits:
        text = F.concat(F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."), F.right(text, F.lit(digits)))
    ahead = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if sign else "")
    return F.when(a < 1e12, F.concat(ahead, text)).otherwise(F.format_string(f"%{'+' * sign}.{digits}f", x))
