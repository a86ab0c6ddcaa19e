"""The text steps of normalization as Column expressions.

Where a match has to be turned into words, the text is cut at the matches with a marker and only the odd pieces are rewritten, which
keeps everything in one projection without UDFs. Each step looks for its trigger first and leaves other texts as they are.
Digits are 0-9. Texts may be null (stay null); U+0001 is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import numerals as N
from ..functions import tables as t
from ..sources.dictionaries import DEFAULTS, Dictionaries
from . import context, lexicon
from .segments import DIGIT, RU, WORD, rewrite

def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, pattern, group)


def _number(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of at most 18 digits as a number, else null."""
    return F.substring(_part(x, pattern, group), 1, 19).try_cast("long")


def typography(text: Column) -> Column:
    out = F.regexp_replace(text, r"\*\*|__|`", "")
    single = {k: v for k, v in t.TYPOGRAPHY.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in t.TYPOGRAPHY.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"([аеёиоуыэюяАЕЁИОУЫЭЮЯ])\+", "$1́")


def _spell_web(x: Column) -> Column:
    out = F.regexp_replace(x, "[.,!?]+$", "")
    for sign, word in t.WEB.items():
        out = F.replace(out, F.lit(sign), F.lit(word))
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def web(text: Column) -> Column:
    w = rf"[{WORD}.+-]"
    out = rewrite(text, rf"(?<![{WORD}])[{WORD}]{w}*@[{WORD}-]+\.[A-Za-zА-Яа-я]{{2,}}(?![{WORD}])", _spell_web, needs="@")
    out = rewrite(out, rf"(?i)(?<![{WORD}])(?:(?:https?://|www\.)\S+|[{WORD}][{WORD}-]*\.(?:com|ru|org|net|info|io|edu|gov|рф)(?![{WORD}]))", _spell_web, needs=r"(?i)://|www\.|\.(?:com|ru|org|net|info|io|edu|gov|рф)")
    return F.regexp_replace(out, "#([A-Za-zА-Яа-яёЁ0-9_]+)", "хештег $1")


def sections(text: Column) -> Column:
    out = text
    for short, full in t.SECTIONS.items():
        out = F.regexp_replace(out, rf"(?iu)(?<![{RU}]){short}\.\s*(?=[0-9])", full + " ")
    return F.when(text.rlike(r"\.(?<=[^0-9\s]\.)\s*[0-9]"), out).otherwise(text)


def digit_groups(text: Column) -> Column:
    return rewrite(text, rf"{DIGIT}(?<![{WORD}])[0-9]{{1,3}}(?: [0-9]{{3}})+(?![{WORD}])", lambda x: F.replace(x, F.lit(" ")))


def dates(text: Column) -> Column:
    p = r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})"

    def date(x):
        month = F.get(F.array(*map(F.lit, t.MONTHS)), (_number(x, p, 2) - 1).cast("int"))
        return F.concat(N.let(_number(x, p, 1), lambda n: N.ordinal(n, "gen")), F.lit(" "), month, F.lit(" "), N.cardinal_of(_number(x, p, 3)), F.lit(" го́да"))

    text = rewrite(text, rf"{DIGIT}(?<![{WORD}]){p}(?![{WORD}])", date)
    return rewrite(text, rf"{DIGIT}(?<![{WORD}])[0-9]{{4}}\s*г\.(?![{RU}])", lambda x: F.concat(N.let(_number(x, "^([0-9]{4})"), lambda n: N.ordinal(n)), F.lit(" го́д")))


def _fraction(x: Column, p: str, agree: bool) -> tuple[Column, Column, Column]:
    fix = N.feminine if agree else (lambda w: w)
    return fix(N.cardinal_text(_part(x, p, 1))), fix(N.cardinal_text(_part(x, p, 2))), F.length(_part(x, p, 2))


def decimal_hyphen(text: Column) -> Column:
    p = r"([0-9]+),([0-9]+)-([а-яёА-ЯЁ]{2,})"

    def words(x):
        whole, part, n = _fraction(x, p, False)
        place = F.coalesce(F.get(F.array(*(F.lit(t.PLACES[i]) for i in (1, 2, 3))), n - 1), F.lit(""))
        front = F.when(_part(x, p, 1).rlike("^0+$"), "").otherwise(F.concat(whole, F.lit(" и ")))
        return F.concat(front, part, F.lit(" "), place, F.lit(" "), _part(x, p, 3))

    return rewrite(text, rf"{DIGIT}(?<![{WORD}]){p}", words)


def compounds(text: Column) -> Column:
    ends = "ий|ый|ой|ая|яя|ое|ее|ые|ие|ого|его|ому|ему|ым|им|ом|ем"
    p = rf"([0-9]+)-([{RU}]{{2,}}(?:{ends})[̀-ͯ]*)"

    def words(x):
        n, last = _number(x, p), F.element_at(F.split(N.cardinal_text(_part(x, p)), " "), -1)
        front = F.when(n == 1, "одно́").when(n == 2, "дву́х").when(n == 3, "трё́х").when(n == 4, "четырё́х").otherwise(F.regexp_replace(last, "ть$", "ти"))
        return F.concat(front, F.regexp_replace(_part(x, p, 2), "[̀-ͯ]", ""))

    return rewrite(text, rf"{DIGIT}(?<![{WORD}]){p}(?![{WORD}])", words)


def times(text: Column) -> Column:
    p = "([0-9]{1,2}):([0-5][0-9])"

    def said(h, m):
        hour = F.when(h == 1, t.HOUR[0]).otherwise(F.concat(N.cardinal_of(h), F.lit(" "), N.plural(h, t.HOUR)))
        return F.concat_ws(" ", hour, F.when(m > 0, F.concat(N.feminine(N.cardinal_of(m)), F.lit(" "), N.plural(m, t.MINUTE))))

    return rewrite(text, rf"{DIGIT}(?<![0-9:]){p}(?![0-9:])", lambda x: N.let(_number(x, p, 1), lambda h: N.let(_number(x, p, 2), lambda m: said(h, m))))


def _fraction_words(num: int, den: int) -> str:
    count = {1: "одна́", 2: "две́", 0: t.ZERO}.get(num) or t.under_thousand(num)
    return f"{count} {t.ordinal_form(den, 'nom_f' if num == 1 else 'pl')}"


def fractions(text: Column) -> Column:
    out = text
    for glyph, (num, den) in t.FRACTIONS.items():
        out = F.replace(out, F.lit(glyph), F.lit(_fraction_words(num, den)))
    return F.when(text.rlike("[¼-¾⅐-↉]"), out).otherwise(text)


def percent(text: Column) -> Column:
    def words(x):
        digits = _part(x, "([0-9]+)")
        last = F.substring(digits, -3, 3).cast("int")
        return F.concat(N.cardinal_text(digits), F.lit(" "), F.when(x.endswith("%"), N.plural(last, t.PERCENT)).otherwise(N.plural(last, t.BASIS_POINT)))

    return rewrite(text, r"[0-9]+\s*[%‱]", words, needs="[%‱]")


def _counted(text: Column, table: dict, flags: str) -> Column:
    names = "|".join(sorted(table, key=len, reverse=True))
    p = rf"{flags}([0-9]+)([^0-9A-Za-z{RU}äöüßÄÖÜ\p{{IsGreek}}]*)({names})"

    def words(x):
        digits, unit = _part(x, p), F.lower(_part(x, p, 3)) if flags else _part(x, p, 3)
        last = F.substring(digits, -3, 3).cast("int")

        def said(number, unit):
            out = None
            for name, (forms, fem) in table.items():
                one = F.concat(N.feminine(number) if fem else number, _part(x, p, 2), N.plural(last, forms))
                out = F.when(unit == name, one) if out is None else out.when(unit == name, one)
            return out

        return N.let(N.cardinal_text(digits), lambda number: N.let(unit, lambda u: said(number, u)))

    return rewrite(text, rf"{DIGIT}(?<![0-9]){p}(?![{RU}])", words)


def multipliers(text: Column) -> Column:
    return _counted(text, t.MULTIPLIERS, "(?iu)")


def measures(text: Column) -> Column:
    return _counted(text, t.MEASURES, "")


def ambiguous_measures(text: Column) -> Column:
    return _counted(text, t.AMBIGUOUS, "")


def ordinal_suffixes(text: Column) -> Column:
    marks = "[̀-ͯ]?"
    ends = "|".join("".join(c + marks for c in s) for s in sorted(t.SUFFIXES, key=len, reverse=True))
    p = rf"([0-9]+)[-‐-―−﹣－]({ends})"

    def words(x):
        end = F.regexp_replace(_part(x, p, 2), "[̀-ͯ]", "")
        return N.let(_number(x, p), lambda n: N.ordinal_where(n, {case: end == suffix for suffix, case in t.SUFFIXES.items()}))

    return rewrite(text, rf"{p}(?![а-яё̀-ͯ])", words)


def symbols(text: Column) -> Column:
    for sign in sorted(t.SYMBOLS, key=lambda s: -len(s)):
        text = F.replace(text, F.lit(sign), F.lit(f" {t.SYMBOLS[sign]} "))
    return F.regexp_replace(text, " {2,}", " ")


def decimals(text: Column) -> Column:
    p = "([0-9]+),([0-9]+)"

    def words(x):
        whole, part, n = _fraction(x, p, True)
        last = F.substring(_part(x, p, 1), -2, 2).cast("int")
        noun = F.when((last % 10 == 1) & (last != 11), "це́лая").otherwise("це́лых")
        place = F.get(F.array(*(F.lit(t.PLACES[i]) for i in (1, 2, 3, 4))), n - 1)
        return F.when(_part(x, p, 2).rlike("^0+$"), N.cardinal_text(_part(x, p, 1))).otherwise(F.concat(whole, F.lit(" "), noun, F.lit(" и́ "), part, F.lit(" "), place))

    return rewrite(text, rf"{DIGIT}(?<![{WORD}]){p}(?![{WORD}])", words)


def currency(text: Column) -> Column:
    number = r"[0-9]+(?:\.[0-9][0-9])?"
    after = "|".join(rf"{name}(?![{RU}])|\{sign}" for _, _, name, sign, _ in t.CURRENCIES.values())
    before = "".join("\\" + x[4] for x in t.CURRENCIES.values() if x[4])

    def words(x):
        def said(a, whole, cents):
            out = None
            for code, (_, _, name, sign, _) in t.CURRENCIES.items():
                own = x.rlike(rf"{name}|\{sign}")
                one = N.money_words(code, F.floor(a).cast("long"), F.round((a - F.floor(a)) * 100, 0).cast("long"), whole, cents)
                out = F.when(own, one) if out is None else out.when(own, one)
            return out

        amount = F.regexp_extract(x, f"({number})", 1).try_cast("decimal(20,2)")
        return N.let(amount, lambda a: N.let(N.cardinal_of(F.floor(a)), lambda whole: N.let(N.cardinal_of(F.round((a - F.floor(a)) * 100, 0)), lambda cents: said(a, whole, cents))))

    return rewrite(text, rf"{number}\s*(?:{after})|[{before}]{number}", words)


def negatives(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:(?<=^)|(?<=[\s(\[]))[-−]([0-9])", "ми́нус $1")


def greek(text: Column) -> Column:
    """A single Greek letter before a dot is named, other Greek letters are read as Cyrillic ones; an acute becomes a stress mark."""
    names = F.create_map(*(F.lit(x) for pair in L.GREEK_NAMES.items() for x in pair))
    out = rewrite(text, rf"(?<![{WORD}])[Α-Ωα-ω](?=\.(?![{WORD}]))", lambda x: F.try_element_at(names, x))
    said = L.greek_letters()
    for tail in (L.ACUTE, "с"):
        own = "".join(k for k, v in said.items() if v[1:] == tail)
        out = F.regexp_replace(out, f"[{own}]", f"$0{tail}")
    out = F.translate(out, "".join(said), "".join(v[0] for v in said.values()))
    return F.when(text.rlike("[Ͱ-Ͽἀ-῿]"), out).otherwise(text)


def latin_fold(text: Column) -> Column:
    """Latin letters without accents, composed or not. Cyrillic й and ё are composed; other letters keep their marks."""
    said = L.latin_letters()
    marks = "|".join(f"{mark}(?<=[{bases}]{mark})" for mark, bases in L.latin_marks().items())
    out = F.regexp_replace(text, marks, "")
    for k, v in said.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    single = {k: v for k, v in said.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for two, one in (("й", "й"), ("Й", "Й"), ("ё", "ё"), ("Ё", "Ё")):
        out = F.replace(out, F.lit(two), F.lit(one))
    return F.when(text.rlike("[À-ž̀-ͯ]"), out).otherwise(text)


def numbers(text: Column) -> Column:
    """What digits remain: those with a preposition or year word by their context, then all others."""
    return N.let(context.numbers_in_context(text), plain_numbers)


def plain_numbers(text: Column) -> Column:
    """What digits remain: a leading zero is read digit by digit, other runs as cardinals."""
    return rewrite(text, "[0-9]+", lambda x: F.when(x.rlike("^0[0-9]"), N.digit_by_digit(x)).otherwise(N.cardinal_text(x)))


Step = Callable[[Column], Column]


def steps(dictionaries: Dictionaries = DEFAULTS) -> dict[str, Step]:
    """The steps by number, in the order in which a text goes through them. Steps 4, 19 and 26 have no effect and are not listed."""
    d = dictionaries
    return {
        "1": typography, "2": web, "3": lambda x: lexicon.substitutions(x, d), "16": lambda x: lexicon.acronyms(x, d), "5": sections, "6": digit_groups, "7": context.ranges, "8": dates, "8.5": decimal_hyphen, "9": compounds, "10": times, "11": fractions, "12": percent,
        "13": multipliers, "14a": measures, "14b": ambiguous_measures, "15": ordinal_suffixes, "20": lambda x: lexicon.restore(x, d), "17b": context.roman_numerals(lexicon.ruler_names(d)), "17": lambda x: lexicon.rulers(x, d), "27": greek, "18": context.alphanumeric, "21": symbols, "22": decimals, "23": currency, "24": negatives,
        "25": numbers, "29": latin_fold, "28": lambda x: lexicon.language_tags(x, d),
    }


STEPS = steps()
OFF = frozenset({"14b"})
#: File order: the cheap steps run over every node before the others.
FAST = ("1", "2", "3", "21", "24", "27", "29")
