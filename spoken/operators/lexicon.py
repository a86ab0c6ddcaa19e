"""Steps that look words up in dictionaries: substitutions, acronyms, rulers, language tags. All are Column expressions; a dictionary is
one literal, dealt by a hash of its keys into small maps, so that looking up takes the same time whatever its size.

What an acronym is read as must not be touched by the steps after it, so step 16 writes a marker of Cyrillic letters that names the
dictionary entry, and step 20 replaces the marker by the reading.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import numerals as N
from ..functions import words as W
from ..sources.dictionaries import Dictionaries, java_pattern
from .context import NOT_ROMAN, _roman
from .segments import RU, WORD, rewrite

# --- fixed values: markers --------------------------------------------------------------------------------------------------------------
OPEN, CLOSE, DIGITS = "ЪььЬььЪ", "ЪььЪььЪ", "абвгдежзийклмнопрстуфхцчшщыэюя"
NEAR = r"[ .,;:!?\-\"'()]"
FEW = 64  # keys that are alternatives of a pattern


def _look_up(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key, or null."""
    n = max(1, len(pairs) // 8)
    parts: list[dict[str, str]] = [{} for _ in range(n)]
    for k, v in pairs.items():
        parts[zlib.crc32(k.encode()) % n][k] = v
    own = F.from_json(F.lit(json.dumps(parts, ensure_ascii=False)), "array<map<string,string>>")
    return F.try_element_at(F.get(own, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def _any(keys) -> str:
    """Whole words, among them those of a list, the longest first. Of a long list, any word with the first letter and length of one of
    its words is a match, which the look-up then decides: long alternatives would be tried at every place of a text."""
    plain = [k for k in keys if re.fullmatch(r"\w+", k)] if len(keys) > FEW else []
    named = sorted(set(keys) - set(plain), key=lambda k: (-len(k), k))
    ways = [re.escape(k) for k in named]
    if plain:
        first, sizes = "".join(sorted({k[0] for k in plain})), [len(k) for k in plain]
        ways.append(rf"(?=[{first}])[{WORD}]{{{min(sizes)},{max(sizes)}}}")
    return rf"(?<![{WORD}])(?:{'|'.join(ways)})(?![{WORD}])"


def _letters(word: str) -> str:
    return " ".join(L.ACRONYM_NAMES.get(c, c) for c in word.lower() if c.strip())


def _halves(value: str) -> tuple[str, str]:
    en, _, ru = value.partition("|")
    return en.strip(), ru.strip()


def _readings(d: Dictionaries) -> dict[str, str]:
    """Marker to reading, for every entry of both dictionaries."""
    said = [v or _letters(k) for k, v in d.ru.items()] + [_halves(v)[0] for v in d.en.values()]
    mark = lambda i: OPEN + "".join(DIGITS[i // 30**k % 30] for k in (3, 2, 1, 0)) + CLOSE
    return {mark(i): reading for i, reading in enumerate(said)}


def substitutions(text: Column, d: Dictionaries) -> Column:
    for pattern, said in d.patterns.items():
        if own := java_pattern(pattern):
            text = F.regexp_replace(text, own, re.sub(r"\\(\d)", r"$\1", said.replace("$", r"\$")))
    return text


def acronyms(text: Column, d: Dictionaries) -> Column:
    """Russian acronyms, then English ones: those with two readings take the Russian one where the nearest letter on a side, past marks
    and blanks, is Cyrillic. Roman numerals and entries without a reading stay."""
    marks = dict(zip([("ru", k) for k in d.ru] + [("en", k) for k in d.en], _readings(d)))
    if d.ru:
        text = rewrite(text, _any(d.ru), lambda x: _look_up({k: marks["ru", k] for k in d.ru}, x))
    said = {k: _halves(v) for k, v in d.en.items() if any(_halves(v)) and not (_roman(k) and k.upper() not in NOT_ROMAN)}
    both = {k: ru for k, (en, ru) in said.items() if en and ru}
    own = {k: marks["en", k] if en else ru for k, (en, ru) in said.items()}
    if both:
        near = lambda left, right: left.rlike(f"[а-яёА-ЯЁ]{NEAR}*$") | right.rlike(f"^{NEAR}*[а-яёА-ЯЁ]")

        def said_in(x: Column, left: Column, right: Column) -> Column:
            return F.coalesce(F.when(near(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))), _look_up(both, x)), _look_up(own, x))

        return rewrite(text, _any(said), said_in, around=True)
    return rewrite(text, _any(said), lambda x: _look_up(own, x)) if said else text


def restore(text: Column, d: Dictionaries) -> Column:
    readings = _readings(d)
    return rewrite(text, f"{OPEN}[а-я]{{4}}{CLOSE}", lambda x: _look_up(readings, x)) if readings else text


def _ruler_cases(d: Dictionaries) -> dict[str, str]:
    """Plain form of a name to the case of the numeral after it; the first dictionary entry and the first case count."""
    found: dict[str, str] = {}
    for name, (gender, *forms) in d.rulers.items():
        sex = "f" if gender == "fem" else "m"
        by_case = dict(zip(("nom", "gen", "dat", "acc", "ins", "prep"), forms))
        order = {"nom": f"nom_{sex}", "gen": "gen", "acc": f"acc_{sex}", "dat": "dat", "ins": "instr", "prep": "prep"}
        for case, ordinal in order.items():
            found.setdefault(L.clean(by_case.get(case, "")), ordinal)
        found.setdefault(L.clean(name), f"nom_{sex}")
    found.pop("", None)
    return found


def ruler_names(d: Dictionaries) -> frozenset[str]:
    return frozenset(_ruler_cases(d))


def rulers(text: Column, d: Dictionaries) -> Column:
    """A ruler's name and a Roman numeral: the numeral is an ordinal that agrees with the name."""
    cases = _ruler_cases(d)
    p = rf"([{RU}]+)\s+([IVXLCDM]+)"
    if not cases:
        return text

    def said(x: Column) -> Column:
        name = F.regexp_extract(x, p, 1)
        case = _look_up(cases, F.regexp_replace(F.translate(F.lower(name), "ёй", "еи"), "[̀-ͯ]", ""))

        def agreed(n: Column) -> Column:
            return F.concat(name, F.lit(" "), N.ordinal_where(n, {own: case == own for own in sorted(set(cases.values()))}))

        return F.when(case.isNotNull(), N.let(N.roman_to_int(F.regexp_extract(x, p, 2)), agreed))

    return rewrite(text, rf"(?<![{WORD}]){p}(?![{WORD}])", said, needs="[IVXLCDM]")


def language_tags(text: Column, d: Dictionaries) -> Column:
    """Latin runs with three Latin letters in a row are put into ``<tts_en>``, without the blanks at their end; single capital
    consonants in them are named, acronyms of the English dictionary are read, accents go."""
    from .steps import latin_fold

    signs = r"\s.,;:!?/&\-–—«»\"'()"
    names = {k: v for k, v in L.ENGLISH_NAMES.items() if k not in "AEIOU"}
    consonant = "[B-DF-HJ-NP-TV-Z]"
    known = {k.upper(): _halves(v)[0] or _letters(k) for k, v in d.en.items() if re.fullmatch("[A-Za-z]{2,}", k)}

    def tagged(block: Column) -> Column:
        out = rewrite(block, rf"(?<![{WORD}]){consonant}(?:\.(?!\s*[A-Z]\.)|(?![{WORD}.]))", lambda x: _look_up(names, F.left(x, F.lit(1))), "\u0002")
        if known:
            out = N.let(out, lambda o: rewrite(o, _any(known), lambda x: _look_up(known, x), "\u0002"))
        return F.concat(F.lit("<tts_en>"), F.trim(latin_fold(out)), F.lit("</tts_en>"))

    bound = rf"[а-яё{WORD}]"
    return rewrite(text, rf"(?<!{bound})[a-zA-ZäöüßÄÖÜ][a-zA-ZäöüßÄÖÜ{signs}]*(?!{bound})", lambda x: F.when(x.rlike("[a-zA-Z]{3}"), N.let(F.regexp_replace(x, r"\s+$", ""), tagged)))
