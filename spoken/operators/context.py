"""Steps whose reading depends on neighbouring words: ranges, Roman numerals, letters with digits, numbers with prepositions and years.

Each is a list of rules over a text's tokens. A rule looks at the token at a position, may rewrite it and its neighbours, and says how
many tokens it has dealt with (0: none, the next rule is asked). They run on Arrow batches, and only for texts that have a trigger;
other texts never leave the JVM. Null texts stay null. Memory holds one text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import letters as L
from ..functions import tables as t
from ..functions import words as W
from .tokens import TOKEN

# --- fixed values: cases that prepositions ask for; year and century words ---------------------------------------------------------------
PREPOSITIONS = {"в": "prep", "во": "prep", "на": "prep", "о": "prep", "об": "prep", "при": "prep", "к": "dat", "ко": "dat", "по": "dat", "с": "gen", "со": "gen", "от": "gen", "до": "gen", "из": "gen", "у": "gen", "для": "gen", "без": "gen", "между": "instr"}
YEAR_KIND = {"год": "one", "г": "one", "года": "few", "году": "few", "годе": "few", "годом": "few", "лет": "many", "годов": "many", "годам": "many", "годах": "many", "годами": "many", "гг": "plural", "годы": "plural"}
YEAR_CASE = {"год": "nom_m", "года": "gen", "году": "dat", "годе": "prep", "годом": "instr", "годов": "pl", "годам": "dat", "годами": "instr", "годах": "prep", "гг": "nom_m", "годы": "nom_m", "лет": "pl", "г": "nom_m"}
YEAR_FORMS = ({"nom_m": "го́д", "gen": "го́да", "dat": "го́ду", "instr": "го́дом", "prep": "году́"}, {"nom_m": "го́да", "gen": "го́да", "dat": "го́ду", "instr": "го́дом", "prep": "году́"}, {"nom_m": "ле́т", "dat": "года́м", "instr": "года́ми", "prep": "года́х"})
RANGE_YEARS = {"годов": ("nom_m", "годо́в"), "лет": ("nom_m", "годо́в"), "годам": ("dat", "года́м"), "годах": ("prep", "года́х"), "годами": ("instr", "года́ми")}
CENTURY_CASE = {"век": "nom_m", "веку": "dat", "века": "gen", "веке": "prep", "веком": "instr", "веков": "pl", "векам": "dat", "веками": "instr", "веках": "prep", "вв": "nom_m", "в": "nom_m"}
CENTURY = {"nom_m": "ве́к", "gen": "ве́ка", "dat": "ве́ку", "instr": "ве́ком", "prep": "ве́ке"}
CENTURIES = {"nom_m": "века́", "gen": "веко́в", "dat": "века́м", "instr": "века́ми", "prep": "века́х", "pl": "веко́в"}
REFERENCES = {"кн": "кни́га", "т": "то́м", "ч": "ча́сть", "гл": "глава́", "разд": "разде́л"}
NOT_ROMAN = ("CD", "DVD", "MD", "DC", "MC", "MI", "MM", "DI", "DIV", "MIX", "CIV", "LCD", "IL", "IC", "ID", "IM")

_TOKEN = re.compile(TOKEN)
_CANONICAL = re.compile("M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")
_CYRILLIC = re.compile("[а-яёА-ЯЁ]")


class Line:
    """A text as words and the gaps before, between and after them. Words outside the text are empty."""

    def __init__(self, text: str):
        self.words, self.gaps, at = [], [], 0
        for m in _TOKEN.finditer(text):
            self.words.append(m.group())
            self.gaps.append(text[at : m.start()])
            at = m.end()
        self.gaps.append(text[at:])

    def __str__(self) -> str:
        return "".join(x for pair in zip(self.gaps, self.words) for x in pair) + self.gaps[-1]

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def gap(self, i: int) -> str:
        """What stands before word i."""
        return self.gaps[i] if 0 <= i < len(self.gaps) else ""

    def dash(self, i: int) -> bool:
        return 0 < i < len(self.words) and self.gaps[i] in ("-", "–", "—")

    def number(self, i: int) -> int | None:
        """Word i as a number, unless it is longer than any number that is read as one."""
        return int(self.words[i]) if self.word(i).isdigit() and len(self.words[i]) <= 4000 else None

    def preposition(self, i: int) -> str | None:
        return PREPOSITIONS.get(L.clean(self.word(i)))

    def drop_dot(self, i: int) -> None:
        if self.gap(i).startswith("."):
            self.gaps[i] = self.gaps[i][1:]

    def put(self, i: int, *said: str | None) -> bool:
        """Writes words from i on, all or (where one is missing) none."""
        if None in said:
            return False
        self.words[i : i + len(said)] = said
        return True


Rule = Callable[[Line, int], int]


def scan(text: str, rules: tuple[Rule, ...]) -> str:
    line, i = Line(text), 0
    while i < len(line.words):
        i += next((n for rule in rules if (n := rule(line, i))), 1)
    return str(line)


def token_step(trigger: str, rules: tuple[Rule, ...]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: scan(x, rules), na_action="ignore")

    barrier = run.asNondeterministic()  # it is not; but so the optimizer does not copy the steps before it into those after it

    def step(text: Column) -> Column:
        return F.coalesce(barrier(F.when(text.rlike(trigger), text)), text)

    return step


def year_form(case: str, n: int) -> str:
    forms = YEAR_FORMS[W.plural_index(n)]
    return forms.get(case, forms["nom_m"])


def _short_thousand(words: str | None) -> str | None:
    return words and words.replace("одна́ ты́сяча", "ты́сяча")


# --- step 7 -----------------------------------------------------------------------------------------------------------------------------
def number_range(line: Line, i: int) -> int:
    first, last = line.number(i), line.number(i + 1)
    if first is None or last is None or not line.dash(i + 1):
        return 0
    noun = line.word(i + 2).lower()
    case = YEAR_CASE.get(L.clean(noun))
    if case is None:
        said, year = (W.cardinal(first), W.cardinal(last)), None
    else:
        asked = line.preposition(i - 1)
        case = "nom_m" if asked and L.clean(line.word(i - 1)) == "по" else asked or case
        if noun in ("гг", "годы"):
            own, year = case, "года́х" if case == "prep" else "го́ды"
        else:
            own, year = RANGE_YEARS.get(noun, (case, year_form(case, 5)))
        said = tuple(_short_thousand(W.ordinal(n, own)) for n in (first, last))
    if line.put(i, *said):
        line.gaps[i + 1] = " - "
        if year:
            line.put(i + 2, year)
            line.drop_dot(i + 3)
    return 2


# --- step 17b ---------------------------------------------------------------------------------------------------------------------------
def _roman(word: str) -> bool:
    return bool(word) and set(word.upper()) <= set(t.ROMAN) and bool(_CANONICAL.fullmatch(word.upper()))


def _century_case(word: str) -> str | None:
    plain = unicodedata.normalize("NFD", word)
    if plain.endswith("а" + L.ACUTE) and L.clean(word) == "века":
        return "nom_m"
    return CENTURY_CASE.get("".join(c for c in plain if not unicodedata.combining(c)))


def _century_form(word: str, case: str, in_range: bool) -> str:
    plain = L.clean(word)
    if in_range and plain == "века" and case in ("gen", "nom_m"):
        return CENTURIES["nom_m"]
    forms = CENTURIES if plain in ("вв", "веков", "векам", "веками", "веках") else CENTURY
    return forms.get(case, forms["nom_m"])


def spell(letters: str) -> str:
    names = (t.LETTERS.get(c.lower()) or L.GREEK_NAMES.get(c, c.lower()) for c in letters if not unicodedata.combining(c))
    return "-".join(names)


def no_numeral(line: Line, i: int) -> int:
    w = line.words[i]
    return 0 if _roman(w) and w.upper() not in NOT_ROMAN else 1


def numeral_with_dash(line: Line, i: int) -> int:
    """Single letters on both sides stay letters; beside other short words the numeral is a number; longer numerals make a range."""
    if line.dash(i + 1):
        w, other = line.words[i], line.words[i + 1]
        if not _roman(other):
            return 2 * line.put(i, W.cardinal(W.roman(w)), spell(other) if len(other) <= 2 else other)
        return 1 if len(w) == len(other) == 1 else 0
    return 1 if line.dash(i) else 0


def initial(line: Line, i: int) -> int:
    """A single letter among initials or Latin words is no numeral."""
    if len(line.words[i]) > 1:
        return 0
    if line.gap(i + 1).startswith(".") and len(line.word(i + 1)) == 1 and line.word(i + 1).isalpha() and line.gap(i + 2).startswith("."):
        return 1
    near = [line.word(j) for j in range(i - 3, i + 4) if j != i]
    return int(any(not _roman(w) and any(c.isascii() and c.isalpha() for c in w) for w in near))


def after_ruler(names: frozenset[str]) -> Rule:
    """Numerals after a ruler's name are left to the rulers' step."""
    return lambda line, i: int(i > 0 and not line.gap(i).strip() and L.clean(line.word(i - 1)) in names)


def reference(line: Line, i: int) -> int:
    if i == 0 or (full := REFERENCES.get(L.clean(line.words[i - 1]))) is None:
        return 0
    line.put(i - 1, full, W.cardinal(W.roman(line.words[i])))
    line.drop_dot(i)
    line.drop_dot(i + 1)
    return 1


def numeral_range(line: Line, i: int) -> int:
    n = 1
    while line.dash(i + n) and _roman(line.words[i + n]):
        n += 1
    if n == 1:
        return 0
    noun = line.word(i + n)
    own = _century_case(noun)
    case = line.preposition(i - 1) or ("nom_m" if own == "gen" else own)
    values = [W.roman(w) for w in line.words[i : i + n]]
    if case and line.put(i, *(W.ordinal(v, case) for v in values)):
        if own:
            line.put(i + n, _century_form(noun, case, True))
            line.drop_dot(i + n + 1)
    else:
        line.put(i, *map(W.cardinal, values))
    return n


def single_numeral(line: Line, i: int) -> int:
    noun, asked, value = line.word(i + 1), line.preposition(i - 1), W.roman(line.words[i])
    own = _century_case(noun)
    case = asked if asked and noun.lower() in PREPOSITIONS else own or asked
    if case is None and len(noun) <= 3 and line.preposition(i + 1):
        case = _century_case(line.word(i + 3 if _roman(line.word(i + 2)) else i + 2))
    if not line.put(i, W.ordinal(value, case) if case else W.cardinal(value)):
        line.put(i, W.cardinal(value))
    if case and own:
        line.put(i + 1, _century_form(noun, case, False))
        line.drop_dot(i + 2)
        return 2
    return 1


# --- step 18 ----------------------------------------------------------------------------------------------------------------------------
def _letter(word: str) -> bool:
    return len(word) == 1 and word.isalpha()


def _code(letters: str) -> str:
    return W.cardinal(W.roman(letters)) if len(letters) > 1 and _roman(letters) and letters.upper() not in NOT_ROMAN else spell(letters)


def initials(line: Line, i: int) -> int:
    n = 0
    while _letter(line.word(i + n)) and line.gap(i + n + 1).startswith("."):
        n += 1
    if n < 2 or set(line.words[i : i + n]) & set(t.ROMAN):
        return 0
    line.put(i, "-".join(map(_code, line.words[i : i + n])) + ", ", *[""] * (n - 1))
    line.gaps[i + 1 : i + n + 1] = [""] * n
    return n


def letter_with_dot(line: Line, i: int) -> int:
    w, gap = line.words[i], line.gap(i + 1)
    comma = gap.startswith(".,")
    if not _letter(w) or w == "в" or w in t.ROMAN or not gap.startswith(".") or (line.word(i + 1).isdigit() and not comma):
        return 0
    line.put(i, _code(w) + "," * comma)
    if comma:
        line.gaps[i + 1] = gap[2:]
    return 1


def dashed_pair(line: Line, i: int) -> int:
    if not line.dash(i + 1):
        return 0
    pair = line.words[i : i + 2]
    if all(_letter(w) and not _CYRILLIC.search(w) for w in pair):
        line.put(i, *map(_code, pair))
    return 2


def letters_before_digits(line: Line, i: int) -> int:
    w = line.words[i]
    letters = [c for c in w if c.isalpha()]
    short = letters and (len(letters) <= 2 or all(c.isupper() for c in letters))
    if not short or line.gap(i + 1) or line.number(i + 1) is None:
        return 0
    line.put(i, _code(w), W.cardinal(line.number(i + 1)))
    line.gaps[i + 1] = " "
    return 2


def digits_before_letters(line: Line, i: int) -> int:
    after = line.word(i + 1)
    if line.number(i) is None or line.gap(i + 1) or not after.isalpha() or not (len(after) == 1 or after.isupper()):
        return 0
    line.put(i, W.cardinal(line.number(i)) + ", ", _code(after))
    return 2


def letter_after_dash(line: Line, i: int) -> int:
    w = line.words[i]
    return int(line.dash(i) and _letter(w) and w not in t.ROMAN and not _CYRILLIC.search(w) and line.put(i, _code(w)))


# --- step 25 ----------------------------------------------------------------------------------------------------------------------------
def _dated_table() -> dict[tuple[str, str], tuple[tuple[str, str, str], tuple[str, str, str]]]:
    """(year word, case that a preposition asks for) to how a number is read (below 2, from 2 to 4, from 5 on: ordinal, cardinal, or
    declined in a case; ``one`` is a word of its own) and to the year word (one, few, many)."""
    by_count = {c: tuple(f.get(c, f["nom_m"]) for f in YEAR_FORMS) for c in ("nom_m", "gen", "dat", "instr", "prep")}
    same = lambda x: (x, x, x)
    table = {}
    for case in by_count:
        oblique = case in ("gen", "dat", "prep")
        table["г", case] = same("ordinal"), same(YEAR_FORMS[0][case])
        table["гг", case] = same("ordinal"), same(YEAR_FORMS[0][case] if oblique else "го́ды")
        table["годы", case] = same("ordinal"), same("го́ды")
        table["год", case] = {"gen": (same("one"), same("го́да")), "dat": (same("ordinal"), same("году́")), "prep": (same("ordinal"), same("году́"))}.get(case, (same("ordinal"), by_count[case]))
        for noun in ("года", "году", "годе", "годом"):
            table[noun, case] = ("ordinal", "gen", "gen") if oblique else same("ordinal"), by_count[case]
        for noun, year in (("лет", "ле́т"), ("годов", "ле́т"), ("годам", "года́м"), ("годах", "года́х"), ("годами", "года́ми")):
            table[noun, case] = ("ordinal", "gen" if case == "gen" else "ordinal", {"nom_m": "cardinal", "dat": "dat"}.get(case, "gen")), same(year)
    return table


DATED = _dated_table()


def _dated(n: int, case: str, noun: str) -> tuple[str | None, str]:
    """A number and its year word, both in the case that a preposition asks for."""
    readings, years = DATED[noun, case]
    reading = readings[0 if n < 2 else 1 if n < 5 else 2]
    said = {"ordinal": lambda: W.ordinal(n, case), "cardinal": lambda: W.cardinal(n), "one": lambda: "одного́"}.get(reading, lambda: W.declined(n, reading))
    return said(), years[W.plural_index(n)]


def number_in_context(line: Line, i: int) -> int:
    """Numbers after a preposition or before a year word. Others stay digits, and so do those that have no ordinal."""
    n = line.number(i)
    if n is None:
        return 1
    noun, asked = line.word(i + 1).lower(), line.preposition(i - 1)
    kind = YEAR_KIND.get(noun)
    since = bool(asked) and L.clean(line.word(i - 1)) == "по"
    case = "nom_m" if since else asked
    if since and 1000 <= n < 2000 and kind:
        said = (_short_thousand(W.ordinal(n)), "го́ды" if kind == "plural" else year_form(case, n))
    elif case and kind:
        said = _dated(n, case, noun)
    elif kind:
        said = (W.cardinal(n), {"гг": "ле́т", "годы": "го́ды"}.get(noun) or year_form("nom_m", n))
    else:
        line.put(i, _short_thousand(W.ordinal(n, case)) if case else None)
        return 1
    if line.put(i, *said) and not (noun == "год" and case in ("gen", "dat", "prep")):
        line.drop_dot(i + 2)
    return 2


_ANY = "a-zA-ZäöüßÄÖÜа-яёА-ЯЁΑ-Ωα-ω"
_YEARS = "|".join(sorted(YEAR_KIND, key=len, reverse=True))
ranges = token_step("[0-9][-–—][0-9]", (number_range,))
#: A letter alone before a dot or a dash, a dash before one, a letter beside a digit; looked for from the dot, dash or digit, which are rarer.
_ALONE = rf"(?<=(?<![{_ANY}])[{_ANY}][-–—.])"
alphanumeric = token_step(rf"[.]{_ALONE}|[-–—](?:{_ALONE}|[{_ANY}](?![{_ANY}]))|[0-9](?:[{_ANY}]|(?<=[{_ANY}̀-ͯ][0-9]))", (initials, letter_with_dot, dashed_pair, letters_before_digits, digits_before_letters, letter_after_dash))
numbers_in_context = token_step(rf"(?iu)[а-яё̀-ͯ][^0-9{_ANY}]*[0-9]|[0-9][^0-9{_ANY}]*(?:{_YEARS})(?![а-яё])", (number_in_context,))


def roman_numerals(rulers: frozenset[str]) -> Callable[[Column], Column]:
    return token_step("(?i)(?=[ivxlcdm])(?<![a-zäöüß])[ivxlcdm]+(?![a-zäöüß])", (no_numeral, numeral_with_dash, initial, after_ruler(rulers), reference, numeral_range, single_numeral))
