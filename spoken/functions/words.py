"""Number words of single Python integers, for rules that look at neighbouring words. They agree with ``numerals``, which tests check."""

from __future__ import annotations

from . import tables as t

# --- fixed values: declined numbers ---------------------------------------------------------------------------------------------------
DECLINED = {
    "gen": {1: "одного́", 2: "дву́х", 3: "трёх", 4: "четырёх", 5: "пяти́", 6: "шести́", 7: "семи́", 8: "восьми́", 9: "девяти́", 10: "десяти́"},
    "dat": {1: "одному́", 2: "дву́м", 3: "трём", 4: "четырём", 5: "пяти́", 6: "шести́", 7: "семи́", 8: "восьми́", 9: "девяти́", 10: "десяти́"},
}
DECLINED_TENS = {2: "двадцати́", 3: "тридцати́", 4: "сорока́", 5: "пяти́десяти", 6: "шести́десяти", 7: "семи́десяти", 8: "восьми́десяти", 9: "девяно́ста"}


def plural_index(n: int) -> int:
    if 11 <= n % 100 <= 14:
        return 2
    return 0 if n % 10 == 1 else 1 if 2 <= n % 10 <= 4 else 2


def agreed(words: str) -> str:
    """Words whose last, if one or two, agrees with a feminine noun."""
    head, _, last = words.rpartition(" ")
    return f"{head} {({'оди́н': 'одна́', 'два́': 'две́'}.get(last, last))}".strip()


def cardinal(n: int) -> str:
    """Words of a number; from 10 ** 18 on digit by digit."""
    if n == 0 or n >= 10**18:
        return " ".join(t.UNITS[int(d)] or t.ZERO for d in str(n))
    parts = []
    for power, *forms in t.SCALES:
        if count := n // 10**power % 1000:
            said = t.under_thousand(count)
            parts += [] if power == 3 and count == 1 else [agreed(said) if power == 3 else said]
            parts.append(forms[plural_index(count)])
    return " ".join([*parts, *filter(None, [t.under_thousand(n % 1000)])])


def ordinal(n: int, case: str = "nom_m") -> str | None:
    """Ordinal words in a case; None where the rules have none (above a thousand: what ends in 000, but for 1000, a million and a
    milliard)."""
    if case not in t.CASES or n >= 10**12:
        return None
    if n < 1000 or n in (1000, 10**6, 10**9):
        return t.ordinal_under_thousand(n, case) if n < 1000 else t.ordinal_form(n, case)
    if n % 1000 == 0:
        return None
    parts = []
    for power, *forms in t.SCALES[2:]:
        if count := n // 10**power % 1000:
            said = t.under_thousand(count)
            parts += [agreed(said) if power == 3 else said, forms[plural_index(count)]]
    return " ".join([*parts, t.ordinal_under_thousand(n % 1000, case)])


def declined(n: int, case: str) -> str:
    """Cardinals below a hundred in the genitive (also prepositional) or dative; others, and 11 to 19, do not change."""
    own = DECLINED[case]
    if n in own:
        return own[n]
    if n < 20 or n >= 100:
        return cardinal(n)
    return " ".join(filter(None, [DECLINED_TENS[n // 10], own.get(n % 10)]))


def roman(text: str) -> int:
    total = before = 0
    for ch in reversed(text.upper()):
        value = t.ROMAN[ch]
        total += value if value >= before else -value
        before = value
    return total
