"""Newline-aware segmentation as column expressions: blocks, fragments and the sentences in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweave.functions.text import normalize_text, punctuation_only, sentences, strip

BLANK_LINES = r"\n(?:[ \t]*\n)+"
#: A line end parts two fragments after `...` or a character other than .!?:; if the next line starts upper case.
FRAGMENT_END = r"\n(?=\p{Lu})(?<=(?:\.\.\.|[^.!?:;\n])\n)"


def fragments(block: Column) -> Column:
    """The fragments of a block without blank lines; lines that belong together are joined by a space."""
    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
    return F.transform(F.split(F.array_join(lines, "\n"), FRAGMENT_END), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))


def block_sentences(t: Column) -> Column:
    """array<struct<block_id int, text string>>: sentences in order, without those of punctuation alone.

    Blocks are parted by blank lines, and only those with a sentence count. A null text gives null, an empty one nothing.
    """
    inside = lambda b: F.filter(F.flatten(F.transform(fragments(b), sentences)), lambda x: ~punctuation_only(x))
    blocks = F.filter(F.transform(F.split(normalize_text(t), BLANK_LINES), inside), lambda x: F.size(x) > 0)
    return F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: F.struct(i.alias("block_id"), x.alias("text")))))


def all_sentences(t: Column) -> Column:
    """array<string>: fragments of the whole text first, then their sentences, without those of punctuation alone.

    Blank lines part fragments as they do blocks.
    """
    inside = lambda b: F.filter(F.flatten(F.transform(fragments(b), sentences)), lambda x: ~punctuation_only(x))
    return F.flatten(F.transform(F.split(normalize_text(t), BLANK_LINES), inside))
