"""Texts cut at the matches of a pattern, so that matches can be turned into words without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
RU = "а-яёА-ЯЁ̀-ͯ"
WORD = r"0-9A-Za-z_\p{L}\p{M}"
DIGIT = "(?=[0-9])"  # before a look-behind, which costs more at each place of a text


def rewrite(text: Column, pattern: str, words: Callable[..., Column], mark: str = MARK, around: bool = False, needs: str = "") -> Column:
    """Every match of ``pattern`` replaced by ``words(match)``, or kept where that is null. With ``around``, ``words`` also gets the text
    between the match and those on both sides of it. ``text`` is named three times, so steps are chained as columns of a DataFrame
    (``plans.pipeline.normalize``), not as nested expressions. A rewrite inside ``words`` takes another mark. ``needs`` is a pattern that
    is quickly looked for and that every text with a match has."""
    pieces = F.split(F.regexp_replace(F.translate(text, mark, ""), pattern, f"{mark}$0{mark}"), mark, -1)
    said = (lambda x, i: words(x, F.get(pieces, i - 1), F.get(pieces, i + 1))) if around else (lambda x, i: words(x))
    out = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.coalesce(said(x, i), x)).otherwise(x)), "")
    hit = text.rlike(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(hit, out).otherwise(text)
