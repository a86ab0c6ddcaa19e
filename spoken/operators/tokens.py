"""The lossless token view of a text: words, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[а-яёА-ЯЁ̀-ͯ]+|[a-zA-ZäöüßÄÖÜ]+|[0-9]+|[Α-Ωα-ω]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def gaps(text: Column) -> Column:
    """One more than words: what stands before, between and after them."""
    return F.split(text, TOKEN, -1)


def join(words: Column, gaps: Column) -> Column:
    """The inverse: gap, word, gap, word, ..., gap."""
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))
