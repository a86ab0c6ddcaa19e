"""Number words, ordinals, agreement and Roman numerals as Column functions.

A group of three digits costs three element look-ups (hundreds, the rest, the counted noun), in literals of ten and of a hundred words
that end in a blank or are empty, so that they are only put together. Larger literals would cost more in planning, which handles every
literal many times, than they save at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t
from .words import agreed, plural_index

_UNDER_HUNDRED = [t.under_thousand(n) for n in range(100)]


def _look_up(words: list[str], index: Column) -> Column:
    """An element of a list of words, which reaches the plan as one literal."""
    return F.get(F.split(F.lit("|".join(words)), "[|]"), index.cast("int"))


def _div(n: Column, by: int) -> Column:
    """Integral quotient."""
    return F.call_function("div", n, F.lit(by))


def _blank(words: list[str]) -> list[str]:
    return [w and w + " " for w in words]


def _group(n: Column, fem: bool = False) -> Column:
    """Words of 0..999 with a blank behind; 0 is empty."""
    rest = [agreed(w) for w in _UNDER_HUNDRED] if fem else _UNDER_HUNDRED
    return F.concat(_look_up(_blank(list(t.HUNDREDS)), _div(n, 100)), _look_up(_blank(rest), n % 100))


def _scale(n: Column, power: int, forms: tuple[str, ...], one: bool) -> Column:
    """Words of the thousands, millions, ... of n with a blank behind; empty where there are none. ``one``: a single thousand is counted."""
    count = _div(n, 10**power) % 1000
    noun = _look_up(_blank([forms[plural_index(i)] for i in range(100)]), count % 100)
    words = _group(count, power == 3)
    if power == 3 and not one:
        words = F.when(count == 1, "").otherwise(words)
    return F.when(count > 0, F.concat(words, noun)).otherwise("")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, for use inside lambdas, where common subexpressions are not shared."""
    return F.get(F.transform(F.array(value), then), 0)


def plural(n: Column, forms: tuple[str, str, str]) -> Column:
    """The form of a counted noun: one, few or many."""
    one = (n % 10 == 1) & (n % 100 != 11)
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(one, forms[0]).when(few, forms[1]).when(n.isNotNull(), forms[2])


def feminine(words: Column) -> Column:
    """Words whose last, if one or two, agrees with a feminine noun."""
    return F.regexp_replace(F.regexp_replace(words, "(^| )оди́н$", "$1одна́"), "(^| )два́$", "$1две́")


def cardinal(n: Column) -> Column:
    """Words of 0 <= n < 10 ** 18; null otherwise."""
    n = n.cast("long")
    parts = [_scale(n, power, tuple(forms), False) for power, *forms in t.SCALES]
    return F.when(n == 0, t.ZERO).when((n > 0) & (n < 10**18), F.rtrim(F.concat(*parts, _group(n % 1000))))


def _words_sql(n: str) -> str:
    """``cardinal`` of a variable as SQL text: one call builds it, where the same as Columns takes hundreds, and planning parses it at once."""
    literal = lambda words: f"split('{'|'.join(words)}', '[|]')"
    hundreds, rest, fem = literal(_blank(list(t.HUNDREDS))), literal(_blank(_UNDER_HUNDRED)), literal(_blank([agreed(w) for w in _UNDER_HUNDRED]))
    group = lambda c, words: f"concat(get({hundreds}, int({c} div 100)), get({words}, int({c} % 100)))"
    parts = []
    for power, *forms in t.SCALES:
        c = f"({n} div {10**power} % 1000)"
        words = f"if({c} = 1, '', {group(c, fem)})" if power == 3 else group(c, rest)
        parts.append(f"if({c} > 0, concat({words}, get({literal(_blank([forms[plural_index(i)] for i in range(100)]))}, int({c} % 100))), '')")
    return f"CASE WHEN {n} = 0 THEN '{t.ZERO}' WHEN {n} > 0 AND {n} < {10**18} THEN rtrim(concat({', '.join(parts)}, {group(f'({n} % 1000)', rest)})) END"


def _each(values: Column, function: str) -> Column:
    """``transform`` with a function in SQL text."""
    return F.call_function("transform", values, F.expr(function))


def cardinal_of(value: Column) -> Column:
    """``cardinal`` for use inside lambdas."""
    return F.get(_each(F.array(value.cast("long")), f"n -> {_words_sql('n')}"), 0)


def cardinal_text(digits: Column) -> Column:
    """Words of a run of digits; from 19 significant digits on it is read digit by digit. For use inside lambdas."""
    names = "|".join([t.ZERO, *t.UNITS[1:]])
    spelled = f"array_join(transform(split(d, ''), c -> get(split('{names}', '[|]'), int(c))), ' ')"
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.get(_each(F.array(short), f"d -> CASE WHEN length(d) <= 18 THEN get(transform(array(try_cast(d AS bigint)), n -> {_words_sql('n')}), 0) ELSE {spelled} END"), 0)


def digit_by_digit(digits: Column) -> Column:
    names = [t.ZERO, *t.UNITS[1:]]
    return F.array_join(F.transform(F.split(digits, ""), lambda d: _look_up(names, d.cast("int"))), " ")


def _ordinal_tail(n: Column, case: str) -> Column:
    """Ordinal words of 0..999; 0 is the cardinal."""
    hundreds = [t.ordinal_under_thousand(100 * h, case) for h in range(10)]
    rest = [t.ordinal_under_thousand(r, case) for r in range(100)]
    mixed = F.concat(_look_up(_blank(list(t.HUNDREDS)), _div(n, 100)), _look_up(rest, n % 100))
    return F.when((n % 100 == 0), _look_up(hundreds, _div(n, 100))).when(n.isNotNull(), mixed)


def ordinal_where(n: Column, cases: dict[str, Column]) -> Column:
    """Ordinal words of n in the first case whose condition holds. Null where the rules have no word: 10 ** 12 and more, and n that ends
    in 000, but for 1000, a million and a milliard. What does not depend on the case is in the plan once."""
    n = n.cast("long")
    rest = n % 1000
    head = [_scale(n, power, tuple(forms), True) for power, *forms in t.SCALES[2:]]
    tail = whole = F.lit(None).cast("string")
    for case, holds in reversed(cases.items()):
        tail = F.when(holds, _ordinal_tail(rest, case)).otherwise(tail)
        single = F.when(n == 1000, t.ordinal_form(1000, case)).when(n == 10**6, t.ordinal_form(10**6, case)).when(n == 10**9, t.ordinal_form(10**9, case))
        whole = F.when(holds, single).otherwise(whole)
    above = (n >= 1000) & (n < 10**12)
    said = let(tail, lambda own: F.when(n < 1000, own).when(above & (rest > 0), F.concat(*head, own)))
    return F.when(n.isin(1000, 10**6, 10**9), whole).when(n >= 0, said)


def ordinal(n: Column, case: str = "nom_m") -> Column:
    """Ordinal words of n in a case (see ``ordinal_where``)."""
    return ordinal_where(n, {case: F.lit(True)})


def roman_to_int(text: Column) -> Column:
    """Subtractive value of a Roman numeral, read from the right."""
    values = F.create_map(*(F.lit(x) for pair in t.ROMAN.items() for x in pair))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))

    def step(acc, ch):
        v = F.coalesce(F.try_element_at(values, ch), F.lit(0))
        return F.struct((acc["total"] + F.when(v < acc["prev"], -v).otherwise(v)).alias("total"), v.alias("prev"))

    return F.aggregate(F.reverse(F.split(F.upper(text), "")), zero, step, lambda acc: acc["total"])


def is_valid_roman(text: Column) -> Column:
    return F.upper(text).rlike("^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")


def to_roman(n: Column) -> Column:
    """Roman numeral of 1..4999."""
    digits = []
    for power, (one, five, ten) in ((1000, "M__"), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        forms = [one * i for i in range(5)] if power == 1000 else ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        digits.append(_look_up(forms, _div(n.cast("long"), power) % 10))
    return F.when(n.between(1, 4999), F.concat(*digits))


def spell(text: Column, sep: str = "-") -> Column:
    """Letter names of a text's letters; other characters stay."""
    names = F.create_map(*(F.lit(x) for pair in t.LETTERS.items() for x in pair))
    return F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), sep)


def money_words(currency: str, whole: Column, cents: Column, whole_words: Column, cents_words: Column) -> Column:
    (main, main_fem), (sub, sub_fem), *_ = t.CURRENCIES[currency]
    agree = lambda words, fem: feminine(words) if fem else words
    low = F.when(cents > 0, F.concat(agree(cents_words, sub_fem), F.lit(" "), plural(cents, sub)))
    return F.concat_ws(" ", agree(whole_words, main_fem), plural(whole, main), low)


def money(amount: Column, currency: str) -> Column:
    """Words of a decimal(20,2) amount: main units, and sub-units where there are any."""
    whole, cents = F.floor(amount).cast("long"), F.round((amount - F.floor(amount)) * 100, 0).cast("long")
    return money_words(currency, whole, cents, cardinal(whole), cardinal(cents))
