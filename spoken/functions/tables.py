"""Fixed values of the normalization rules: spoken forms with their stress marks (U+0301), and the typographic replacements."""

from __future__ import annotations

# --- fixed values: number words -----------------------------------------------------------------------------------------------
UNITS = ("", "оди́н", "два́", "три́", "четы́ре", "пя́ть", "ше́сть", "се́мь", "во́семь", "де́вять")
TEENS = ("де́сять", "оди́ннадцать", "двена́дцать", "трина́дцать", "четы́рнадцать", "пятна́дцать", "шестна́дцать", "семна́дцать", "восемна́дцать", "девятна́дцать")
TENS = ("", "де́сять", "два́дцать", "три́дцать", "со́рок", "пятьдеся́т", "шестьдеся́т", "се́мьдесят", "во́семьдесят", "девяно́сто")
HUNDREDS = ("", "сто́", "две́сти", "три́ста", "четы́реста", "пятьсо́т", "шестьсо́т", "семьсо́т", "восемьсо́т", "девятьсо́т")
ZERO = "но́ль"
SCALES = ((15, "квадриллио́н", "квадриллио́на", "квадриллио́нов"), (12, "триллио́н", "триллио́на", "триллио́нов"), (9, "миллиа́рд", "миллиа́рда", "миллиа́рдов"), (6, "миллио́н", "миллио́на", "миллио́нов"), (3, "ты́сяча", "ты́сячи", "ты́сяч"))

# --- fixed values: ordinal stems (the last entry of a pair says that the ending is stressed) and endings by case --------------------
ORDINAL_STEMS = {1: ("пе́рв", False), 2: ("втор", True), 4: ("четвё́рт", False), 5: ("пя́т", False), 6: ("шест", True), 7: ("седьм", True), 8: ("восьм", True), 9: ("девя́т", False), 10: ("деся́т", False), 11: ("оди́ннадцат", False), 12: ("двена́дцат", False), 13: ("трина́дцат", False), 14: ("четы́рнадцат", False), 15: ("пятна́дцат", False), 16: ("шестна́дцат", False), 17: ("семна́дцат", False), 18: ("восемна́дцат", False), 19: ("девятна́дцат", False), 20: ("двадца́т", False), 30: ("тридца́т", False), 40: ("сороков", True), 50: ("пятидеся́т", False), 60: ("шестидеся́т", False), 70: ("семидеся́т", False), 80: ("восьмидеся́т", False), 90: ("девяно́ст", False), 100: ("со́т", False), 200: ("двухсо́т", False), 300: ("трёхсо́т", False), 400: ("четырёхсо́т", False), 500: ("пятисо́т", False), 600: ("шестисо́т", False), 700: ("семисо́т", False), 800: ("восьмисо́т", False), 900: ("девятисо́т", False), 1000: ("ты́сячн", False), 10**6: ("миллио́нн", False), 10**9: ("миллиа́рдн", False)}
CASES = ("nom_m", "gen", "dat", "acc_m", "acc_f", "instr", "prep", "nom_f", "nom_n", "nom_pl", "pl", "instr_pl")
PLAIN_ENDINGS = dict(zip(CASES, ("ый", "ого", "ому", "ого", "ую", "ым", "ом", "ая", "ое", "ые", "ых", "ыми")))
STRESSED_ENDINGS = dict(zip(CASES, ("о́й", "о́го", "о́му", "о́го", "у́ю", "ы́м", "о́м", "а́я", "о́е", "ы́е", "ы́х", "ы́ми")))
THIRD = dict(zip(CASES, ("тре́тий", "тре́тьего", "тре́тьему", "тре́тьего", "тре́тью", "тре́тьим", "тре́тьем", "тре́тья", "тре́тье", "тре́тьи", "тре́тьих", "тре́тьими")))
SIXTH_PLURAL = "ше́стые"

# --- fixed values: typography, web, sections, months, fractions -------------------------------------------------------------------
TYPOGRAPHY = {" ": " ", " ": " ", " ": " ", "⁠": " ", "’": "'", "‘": "'", "‑": "-", "—": "-", "–": "-", "“": '"', "”": '"', "«": '"', "»": '"', "‚": "'", "‛": "'", "…": "..."}
WEB = {"@": " соба́ка ", ".": " то́чка ", "/": " слэ́ш ", ":": " двоето́чие ", "-": " дефи́с ", "_": " подчё́ркивание "}
SECTIONS = {"ст": "статья́", "пп": "подпу́нкт", "табл": "табли́ца", "рис": "рису́нок", "гл": "глава́", "п": "пу́нкт"}
MONTHS = ("января́", "февраля́", "ма́рта", "апре́ля", "ма́я", "ию́ня", "ию́ля", "а́вгуста", "сентября́", "октября́", "ноября́", "декабря́")
FRACTIONS = {"¼": (1, 4), "½": (1, 2), "¾": (3, 4), "⅐": (1, 7), "⅑": (1, 9), "⅒": (1, 10), "⅓": (1, 3), "⅔": (2, 3), "⅕": (1, 5), "⅖": (2, 5), "⅗": (3, 5), "⅘": (4, 5), "⅙": (1, 6), "⅚": (5, 6), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8), "↉": (0, 3)}

# --- fixed values: counted nouns (one, few, many) and whether they are feminine ---------------------------------------------------
PERCENT = ("проце́нт", "проце́нта", "проце́нтов")
BASIS_POINT = ("ба́зисный пу́нкт", "ба́зисных пу́нкта", "ба́зисных пу́нктов")
HOUR, MINUTE = ("ча́с", "часа́", "часо́в"), ("мину́та", "мину́ты", "мину́т")
MULTIPLIERS = {"тыс": (("ты́сяча", "ты́сячи", "ты́сяч"), True), "млн": (("миллио́н", "миллио́на", "миллио́нов"), False), "млрд": (("миллиа́рд", "миллиа́рда", "миллиа́рдов"), False)}
MEASURES = {"км": (("киломе́тр", "киломе́тра", "киломе́тров"), False), "м": (("ме́тр", "ме́тра", "ме́тров"), False), "см": (("сантиме́тр", "сантиме́тра", "сантиме́тров"), False), "мм": (("миллиме́тр", "миллиме́тра", "миллиме́тров"), False), "кг": (("килогра́мм", "килогра́мма", "килогра́ммов"), False), "л": (("ли́тр", "ли́тра", "ли́тров"), False), "ч": (("ча́с", "часа́", "часо́в"), False), "мин": (("мину́та", "мину́ты", "мину́т"), True), "сек": (("секу́нда", "секу́нды", "секу́нд"), True), "га": (("гекта́р", "гекта́ра", "гекта́ров"), False), "Гц": (("ге́рц", "ге́рца", "ге́рц"), False), "Вт": (("ва́тт", "ва́тта", "ва́тт"), False)}
AMBIGUOUS = {"А": (("ампе́р", "ампе́ра", "ампе́р"), False), "В": (("во́льт", "во́льта", "во́льт"), False), "г": (("гра́мм", "гра́мма", "гра́ммов"), False)}
PLACES = {1: "деся́тых", 2: "со́тых", 3: "ты́сячных", 4: "десятиты́сячных"}
SUFFIXES = {"го": "gen", "му": "dat", "й": "nom_m", "м": "prep", "я": "nom_f", "ю": "acc_f", "е": "nom_pl", "х": "pl"}

# --- fixed values: currencies: (main forms, feminine), (sub forms, feminine), pattern after the number, sign before it --------------
CURRENCIES = {
    "rub": ((("ру́бль", "рубля́", "рубле́й"), False), (("копе́йка", "копе́йки", "копе́ек"), True), "(?:руб|ру́б)(?:ле́й|ля́|ль)?", "₽", None),
    "usd": ((("до́ллар", "до́ллара", "до́лларов"), False), (("це́нт", "це́нта", "це́нтов"), False), "до́ллар(?:о́в|а|ы)?", "$", "$"),
    "eur": ((("е́вро", "е́вро", "е́вро"), False), (("евроце́нт", "евроце́нта", "евроце́нтов"), False), "е́вро", "€", "€"),
    "gbp": ((("фу́нт сте́рлингов", "фу́нта сте́рлингов", "фу́нтов сте́рлингов"), False), (("пе́нс", "пе́нса", "пе́нсов"), False), "фу́нт", "£", "£"),
    "jpy": ((("ие́на", "ие́ны", "ие́н"), True), (("се́на", "се́ны", "се́н"), True), "ие́н", "¥", "¥"),
    "uah": ((("гри́вна", "гри́вны", "гри́вен"), True), (("копе́йка", "копе́йки", "копе́ек"), True), "гри́в(?:ен|на|ны)?", "₴", "₴"),
    "kzt": ((("тенге́", "тенге́", "тенге́"), False), (("тиы́н", "тиы́на", "тиы́нов"), False), "тенге́", "₸", "₸"),
}

# --- fixed values: symbols, letters ------------------------------------------------------------------------------------------------
SYMBOLS = {"±": "плю́с ми́нус", "≈": "приблизи́тельно равно́", "∼": "приблизи́тельно", "≠": "не́ равно́", "≤": "ме́ньше и́ли равно́", "≥": "бо́льше и́ли равно́", "×": "умно́жить на́", "·": "умно́жить на́", "÷": "раздели́ть на́", "∞": "бесконе́чность", "′": "штри́х", "″": "два́ штриха́", "√": "квадра́тный ко́рень", "∛": "куби́ческий ко́рень", "∜": "ко́рень четвё́ртой сте́пени", "∅": "пусто́е мно́жество", "∈": "принадлежи́т", "∉": "не́ принадлежи́т", "∫": "интегра́л", "²": "в ква́драте", "³": "в ку́бе", "§": "пара́граф", "§§": "парагра́фы", "№": "но́мер", "&": "э́нд", "©": "ко́пирайт", "®": "резе́рвед", "™": "тэ-э́м", "‰": "проми́лле", "†": "кре́стик", "‡": "двойно́й кре́стик", "•": "пу́нкт", "→": "стре́лка впра́во", "←": "стре́лка вле́во", "↔": "стре́лка в о́бе сто́роны", "↑": "стре́лка вве́рх", "↓": "стре́лка вни́з"}
LETTERS = {"а": "а́", "б": "бэ́", "в": "вэ́", "г": "гэ́", "д": "дэ́", "е": "е́", "ё": "ё́", "ж": "жэ́", "з": "зэ́", "и": "и́", "й": "и кра́ткое", "к": "ка́", "л": "э́ль", "м": "э́м", "н": "э́н", "о": "о́", "п": "пэ́", "р": "э́р", "с": "э́с", "т": "тэ́", "у": "у́", "ф": "э́ф", "х": "ха́", "ц": "цэ́", "ч": "че́", "ш": "ша́", "щ": "ща́", "ъ": "твё́рдый зна́к", "ы": "ы́", "ь": "мя́гкий зна́к", "э": "э́", "ю": "ю́", "я": "я́", "a": "э́й", "b": "би́", "c": "си́", "d": "ди́", "e": "и́", "f": "э́ф", "g": "джи́", "h": "э́йч", "i": "а́й", "j": "дже́й", "k": "ке́й", "l": "э́л", "m": "э́м", "n": "э́н", "o": "о́у", "p": "пи́", "q": "кью́", "r": "а́р", "s": "э́с", "t": "ти́", "u": "ю́", "v": "ви́", "w": "да́бл ю́", "x": "э́кс", "y": "уа́й", "z": "зе́д"}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def under_thousand(n: int) -> str:
    """Cardinal words of 0..999; 0 is empty."""
    h, t, u = n // 100, n // 10 % 10, n % 10
    parts = [HUNDREDS[h], TEENS[u] if t == 1 else TENS[t], "" if t == 1 else UNITS[u]]
    return " ".join(p for p in parts if p)


def ordinal_form(n: int, case: str) -> str | None:
    """The one-word ordinals."""
    if n == 3:
        return THIRD[case]
    if n == 6 and case == "nom_pl":
        return SIXTH_PLURAL
    if n not in ORDINAL_STEMS:
        return None
    stem, stressed = ORDINAL_STEMS[n]
    return stem + (STRESSED_ENDINGS if stressed else PLAIN_ENDINGS)[case]


def ordinal_under_thousand(n: int, case: str) -> str:
    """Ordinal words of 1..999; 0 stays the cardinal."""
    if n == 0:
        return ZERO
    if form := ordinal_form(n, case):
        return form
    head = n // 100 * 100 or n // 10 * 10
    return under_thousand(head) + " " + ordinal_under_thousand(n - head, case)
