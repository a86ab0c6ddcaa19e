"""Letters of other scripts: Greek and accented Latin read as plain letters, names of letters, Latin words in Cyrillic."""

from __future__ import annotations

import unicodedata

from . import tables as t

ACUTE = "́"
VOWELS = "αεηιουω"

# --- fixed values: Greek letters in Cyrillic, and their names -------------------------------------------------------------------------
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ("а", "в", "г", "д", "е", "з", "и", "ф", "и", "к", "л", "м", "н", "кс", "о", "п", "р", "с", "с", "т", "и", "ф", "х", "пс", "о")))
GREEK_NAMES = {"α": "а́льфа", "β": "бэ́та", "γ": "га́мма", "δ": "дэ́льта", "ε": "э́псилон", "ζ": "дзэ́та", "η": "э́та", "θ": "тэ́та", "ι": "йо́та", "κ": "ка́ппа", "λ": "ля́мбда", "μ": "мю́", "ν": "ню́", "ξ": "кси́", "ο": "омикро́н", "π": "пи́", "Ρ": "ро́", "ρ": "ро", "σ": "си́гма", "ς": "си́гма", "τ": "та́у", "υ": "ю́псилон", "φ": "фи́", "χ": "хи́", "ψ": "пси́", "ω": "оме́га"}
GREEK_NAMES |= {k.upper(): v for k, v in GREEK_NAMES.items() if k not in "ςΡρ"}

# --- fixed values: Latin letters that do not decompose; English and Russian letter names -------------------------------------------------
LATIN_SPECIAL = {"Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "Th", "ß": "ss", "æ": "ae", "ð": "d", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "Œ": "OE", "œ": "oe"}
ENGLISH_NAMES = {"A": "ay", "B": "bee", "C": "see", "D": "dee", "E": "ee", "F": "ef", "G": "jee", "H": "aitch", "I": "eye", "J": "jay", "K": "kay", "L": "el", "M": "em", "N": "en", "O": "oh", "P": "pee", "Q": "cue", "R": "ar", "S": "ess", "T": "tee", "U": "you", "V": "vee", "W": "double you", "X": "ex", "Y": "wy", "Z": "zed"}
ACRONYM_NAMES = t.LETTERS | {"а": "а", "й": "и́ кра́ткое"}

# --- fixed values: Latin to Cyrillic for words with a vowel, and letter names for words without one ---------------------------------------
TRANSLIT = {"ce": "се", "ch": "ч", "ci": "си", "cy": "си", "ge": "джэ", "gi": "джи", "gy": "джи", "kh": "х", "ph": "ф", "qu": "кв", "sh": "ш", "th": "з", "wh": "в", "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "и", "z": "з"}
TRANSLIT_NAMES = {"a": "эй", "b": "би", "c": "си", "d": "ди", "e": "и", "f": "эф", "g": "джи", "h": "эйч", "i": "ай", "j": "джей", "k": "кей", "l": "эль", "m": "эм", "n": "эн", "o": "оу", "p": "пи", "q": "кью", "r": "эр", "s": "эс", "t": "ти", "u": "ю", "v": "ви", "w": "дабл ю", "x": "экс", "y": "уай", "z": "зэд"}


def greek_letters() -> dict[str, str]:
    """Every Greek letter that is read: the plain ones, and vowels with one breathing, diaeresis or iota below, with or without an
    acute. The acute becomes a stress mark; letters with a grave or circumflex stay."""
    found = {}
    for code in (*range(0x370, 0x400), *range(0x1F00, 0x2000)):
        ch = chr(code)
        base, *marks = unicodedata.normalize("NFD", ch)
        said = GREEK.get(base) or (GREEK.get(base.lower(), "").capitalize() if base.lower().upper() == base else "")
        others = [m for m in marks if m != ACUTE]
        plain = not marks or (base.lower() in VOWELS and len(others) <= 1 and set(others) <= {"̓", "̔", "̈", "ͅ"})
        if said and plain and unicodedata.normalize("NFC", ch) == ch:
            found[ch] = said + ACUTE * (ACUTE in marks)
    return found


def latin_letters() -> dict[str, str]:
    """Accented letters of Latin-1 and Latin Extended-A without their accents."""
    found = dict(LATIN_SPECIAL)
    for code in range(0xC0, 0x17F):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.isalpha():
            found[chr(code)] = base
    return found


def latin_marks() -> dict[str, str]:
    """Combining mark to the ASCII letters that it composes with in ``latin_letters``."""
    found: dict[str, str] = {}
    for ch in latin_letters():
        base, *marks = unicodedata.normalize("NFD", ch)
        if marks:
            found[marks[0]] = found.get(marks[0], "") + base
    return found


def clean(word: str) -> str:
    """The form in which words are compared: lower case, without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
