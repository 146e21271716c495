"""Checks of generated entries and the reading of a language model's answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweave.functions.text import strip

#: What an entry must not name; a term of several words counts anywhere, a single word as a whole.
BANNED = ("mental entropy", "mes", "entropy", "coherence score", "subscore", "subscores", "classification", "scoring", "language model")
#: What a generated entry must not contain anywhere, and its least and greatest length.
BANNED_PARTS = ("entropy", "coherence score", "mes score", "mental entropy", "disorganization score", "fragmentation level", "as an ai", "i'm an ai", "language model")
SHORTEST, LONGEST = 50, 3000
#: Patterns of e-mail addresses, telephone numbers and street addresses.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}"
STREETS = ("St", "Street", "Ave", "Avenue", "Blvd", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Court", "Ct")
WORD = r"[\p{L}\p{N}_]"
ADDRESS = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])[0-9]{{1,5}}\s+{WORD}+(?:\s+{WORD}+){{0,3}}\s+(?:{'|'.join(STREETS)})(?:$|[^\p{{L}}\p{{N}}_])"
#: Fields of a label and what stands for a missing one.
LABEL_FIELDS = {"prediction_coherence": 3, "model_complexity": 3, "compression_progress": 3, "belief_integration": 5, "precision_weighting": 3, "overall_entropy": 5}


def banned_word(word: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){word}(?:$|[^\p{{L}}\p{{N}}_])"


def disallowed(text: Column, low: Column | None = None) -> Column:
    """Whether a text names a banned term, an e-mail address, a telephone number or a street address.

    `low` is the text in lower case where it is a column already. Patterns are tried where the text holds a part of theirs.
    """
    low = F.lower(text) if low is None else low
    out = (F.contains(text, F.lit("@")) & text.rlike(EMAIL)) | (text.rlike("[0-9]") & (text.rlike(PHONE) | text.rlike(ADDRESS)))
    for term in BANNED:
        held = F.contains(low, F.lit(term))
        out = out | (held if " " in term else held & low.rlike(banned_word(term)))
    return out


def valid_entry(text: Column, low: Column | None = None) -> Column:
    """Whether an entry's length is within bounds and it contains none of BANNED_PARTS; null is not valid."""
    low = F.lower(text) if low is None else low
    ok = F.length(text).between(SHORTEST, LONGEST)
    for term in BANNED_PARTS:
        ok = ok & ~F.contains(low, F.lit(term))
    return F.coalesce(ok, F.lit(False))


def unfenced(raw: Column) -> Column:
    """Without white space around and a code fence."""
    t = strip(raw)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))).otherwise(t)


def one_value(json: Column) -> Column:
    """An array of the one JSON value that a text is, null for anything else: Spark's parser alone would pass a rest over."""
    parsed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return F.when(F.try_variant_get(parsed, "$[1]", "variant").isNull(), parsed)


def string_field(json: Column, field: str) -> Column:
    """A field of a JSON object if it is a string, else null; bad JSON gives null."""
    value = one_value(json)
    part = F.try_variant_get(value, f"$[0].{field}", "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(value, f"$[0].{field}", "string"))


def unwrapped_text(raw: Column, field: str = "journal_text") -> Column:
    """The text of an answer: the field of the whole object, else of the outermost braces; empty if there is none."""
    t = unfenced(raw)
    begin, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((begin > 0) & (F.instr(t, "}") > 0) & (end > begin), F.substring(t, begin, end - begin + 1))
    return F.coalesce(strip(string_field(F.coalesce(inner, F.lit("")), field)), F.lit(""))


def label_fields(raw: Column) -> dict[str, Column]:
    """A label's numbers from an answer, missing ones by default and cut to whole; `bad` where there is no JSON object or a
    field that is no number."""
    t = unfenced(raw)
    value = one_value(t)
    out = {}
    bad = value.isNull() | ~t.startswith("{")
    for field, default in LABEL_FIELDS.items():
        part = F.try_variant_get(value, f"$[0].{field}", "variant")
        number = F.try_variant_get(value, f"$[0].{field}", "double").cast("int")
        out[field] = F.when(part.isNull(), F.lit(default)).otherwise(number)
        bad = bad | (part.isNotNull() & number.isNull())
    return {**out, "bad": bad}
