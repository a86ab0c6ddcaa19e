"""Queries of the steps that look at context and dictionaries: every rule on generated rows (prepositions, nouns, numbers), with the words
that the rules ask for stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import numerals as N
from ..functions import tables as t
from ..operators import context as C
from ..operators.steps import STEPS, steps
from ..sources.dictionaries import DEFAULTS, Dictionaries
from .sql import cardinal, declined, ordinal, ordinal99, plural, query, quote, read, words_list

#: Two sizes of a number: 1..50, and a year of the last century.
NUMBERS = "WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part), v AS (SELECT n FROM n UNION ALL SELECT n + 1900 FROM n)"
ROMANS = [a + b for a in ("", "X", "XX", "XXX", "XL", "L") for b in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
SIMPLE = {"nom_m": "nom_m", "gen": "gen", "dat": "dat", "instr": "instr", "prep": "prep"}


def _cases(pairs: dict[str, str], of: str = "x") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in pairs.items()) + " END"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else quote(x) for x in r) + ")" for r in rows) + f") AS u({names})"


def _frames(spark, sf_dir, rows: list[tuple[str, ...]], names: list[str], years: bool = False) -> DataFrame:
    """Every number with every row of words."""
    n = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    n = n.unionByName(n.select((F.col("n") + 1900).alias("n"))) if years else n
    words = F.array(*(F.struct(*(F.lit(x).cast("string").alias(c) for x, c in zip(r, names))) for r in rows))
    return n.select("n", F.inline(words))


def _ordinals(of: str, n: str = "n") -> str:
    return _cases({c: ordinal(n, c) for c in SIMPLE}, of)


# --- step 25: a number after a preposition, before a year word, both or none --------------------------------------------------------------
_PREPS = [None, *C.PREPOSITIONS]
_NOUNS = [None, *C.YEAR_KIND]


def _number_rows() -> list[tuple]:
    """(preposition, noun, case, readings below 2, to 4, from 5; year words for one, few, many)."""
    out = []
    for prep in _PREPS:
        case = "nom_m" if prep == "по" else C.PREPOSITIONS.get(prep)
        for noun in _NOUNS:
            if case and noun:
                (readings, years) = C.DATED[noun, case]
            elif noun:
                readings, years = ("cardinal",) * 3, {"гг": ("ле́т",) * 3, "годы": ("го́ды",) * 3}.get(noun) or tuple(f["nom_m"] for f in C.YEAR_FORMS)
            else:
                readings, years = (("ordinal" if case else "cardinal"),) * 3, (None,) * 3
            out.append((prep, noun, case, *readings, *years))
    return out


def _since(n: str) -> str:
    """After "по", a year of the last century is an ordinal, with its noun."""
    return f"({n} >= 1000 AND prep = 'по' AND noun IS NOT NULL)"


#: Beside a year word the ordinal keeps the one of its thousand.
_ORDINAL = f"CASE WHEN n > 1000 AND noun IS NOT NULL THEN 'одна́ ' || {_ordinals('kase')} ELSE {_ordinals('kase')} END"
_READ = _cases({"ordinal": _ORDINAL, "cardinal": cardinal("n"), "one": "'одного́'", "gen": declined("n", "gen"), "dat": declined("n", "dat")}, "CASE WHEN n < 2 THEN r1 WHEN n < 5 THEN r2 ELSE r5 END")
_FORMS = [tuple(f.get("nom_m") for f in C.YEAR_FORMS)]


@query(
    f"{NUMBERS}, u AS (SELECT * FROM {_values(_number_rows(), 'prep, noun, kase, r1, r2, r5, y1, y2, y5')}) SELECT n, prep, noun, concat_ws(' ', prep, CASE WHEN {_since('n')} THEN {ordinal('n', 'nom_m')} ELSE {_READ} END, "
    f"CASE WHEN {_since('n')} THEN CASE WHEN noun IN ('гг', 'годы') THEN 'го́ды' ELSE {plural('n', _FORMS[0])} END ELSE CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN y1 WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN y2 ELSE y5 END END, "
    "CASE WHEN noun IS NULL THEN 'дома' END) || ',' AS spoken FROM v, u"
)
def numbers_context(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(p, x) for p in _PREPS for x in _NOUNS], ["prep", "noun"], True)
    text = F.concat(F.concat_ws(" ", "prep", F.col("n").cast("string"), F.coalesce("noun", F.lit("дома"))), F.lit(","))
    return rows.withColumn("spoken", text).withColumn("spoken", STEPS["25"](F.col("spoken")))


# --- step 7: ranges -----------------------------------------------------------------------------------------------------------------------
def _range_rows() -> list[tuple]:
    out = []
    for prep in _PREPS:
        asked = "nom_m" if prep == "по" else C.PREPOSITIONS.get(prep)
        for noun in (None, *C.YEAR_CASE):
            own = C.YEAR_CASE.get(noun)
            case = asked or own
            if noun is None:
                kase, year = None, None
            elif noun in ("гг", "годы"):
                kase, year = case, "года́х" if case == "prep" else "го́ды"
            else:
                kase, year = {"годов": ("nom_m", "годо́в"), "лет": ("nom_m", "годо́в"), "годам": ("dat", "года́м"), "годах": ("prep", "года́х"), "годами": ("instr", "года́ми")}.get(noun) or (case, C.YEAR_FORMS[2].get(case, "ле́т"))
            out.append((prep, noun, kase, year))
    return out


@query(f"{NUMBERS}, u AS (SELECT * FROM {_values(_range_rows(), 'prep, noun, kase, year')}) SELECT n, prep, noun, concat_ws(' ', prep, coalesce({_ordinals('kase')}, {cardinal('n')}) || ' - ' || coalesce({_ordinals('kase', '(n + 1)')}, {cardinal('(n + 1)')}), coalesce(year, 'домов.')) AS spoken FROM v, u")
def number_ranges(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(p, x) for p in _PREPS for x in (None, *C.YEAR_CASE)], ["prep", "noun"], True)
    text = F.concat(F.concat_ws(" ", "prep", F.concat(F.col("n").cast("string"), F.lit("-"), (F.col("n") + 1).cast("string")), F.coalesce("noun", F.lit("домов"))), F.lit("."))
    return rows.withColumn("spoken", text).withColumn("spoken", STEPS["7"](F.col("spoken")))


# --- step 17b: Roman numerals ---------------------------------------------------------------------------------------------------------------
_CENTURY_NOUNS = [None, *C.CENTURY_CASE]


def _century_rows() -> list[tuple]:
    """(preposition, noun, case of one numeral, century word; case of a range, its century word)."""
    out = []
    for prep in _PREPS:
        asked = C.PREPOSITIONS.get(prep)
        for noun in _CENTURY_NOUNS:
            own = C.CENTURY_CASE.get(noun)
            case = asked if asked and noun in C.PREPOSITIONS else own or asked
            forms = C.CENTURIES if noun in ("вв", "веков", "векам", "веками", "веках") else C.CENTURY
            single = None if own is None or case is None else forms.get(case, forms["nom_m"])
            many = asked or ("nom_m" if own == "gen" else own)
            several = None if own is None or many is None else C.CENTURIES["nom_m"] if noun == "века" and many in ("gen", "nom_m") else forms.get(many, forms["nom_m"])
            out.append((prep, noun, case, single, many, several))
    return out


_ALL = {c: c for c in ("nom_m", "gen", "dat", "instr", "prep", "pl")}


def _roman_ordinals(of: str, n: str) -> str:
    return _cases({c: ordinal99(n, c) for c in _ALL}, of)


@query(
    f"WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part), u AS (SELECT * FROM {_values(_century_rows(), 'prep, noun, k1, y1, k2, y2')}) "
    f"SELECT n, prep, noun, concat_ws(' ', prep, coalesce({_roman_ordinals('k1', 'n')}, {cardinal('n')}), coalesce(y1, noun, 'дом')) || CASE WHEN y1 IS NULL THEN '. ' ELSE ' ' END || 'Конец' AS single, "
    f"concat_ws(' ', prep, coalesce({_roman_ordinals('k2', 'n')}, {cardinal('n')}) || '-' || coalesce({_roman_ordinals('k2', '(n + 1)')}, {cardinal('(n + 1)')}), coalesce(y2, noun, 'дом')) || CASE WHEN y2 IS NULL THEN '. ' ELSE ' ' END || 'Конец' AS several FROM n, u WHERE n > 10 AND n % 10 <> 9"
)
def roman_generic(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(p, x) for p in _PREPS for x in _CENTURY_NOUNS], ["prep", "noun"]).filter("n > 10 and n % 10 <> 9")
    noun = F.coalesce("noun", F.lit("дом"))
    single = F.concat(F.concat_ws(" ", "prep", N.to_roman(F.col("n")), noun), F.lit(". Конец"))
    several = F.concat(F.concat_ws(" ", "prep", F.concat(N.to_roman(F.col("n")), F.lit("-"), N.to_roman(F.col("n") + 1)), noun), F.lit(". Конец"))
    return rows.withColumns({"single": single, "several": several}).withColumns({"single": STEPS["17b"](F.col("single")), "several": STEPS["17b"](F.col("several"))})


@query(
    "WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) "
    + " UNION ALL ".join(f"SELECT n, {quote(f'{k}. ')} AS kind, {quote(v + ' ')} || {cardinal('n')} || ' тут' AS spoken FROM n" for k, v in C.REFERENCES.items())
    + f" UNION ALL SELECT n, 'stop', 'LCD, MIX, DIV' FROM n UNION ALL SELECT n, 'ruler', 'Пётр ' || {words_list(ROMANS)}[n + 1] FROM n UNION ALL SELECT n, 'dash', {cardinal('n')} || '-бэ́' FROM n UNION ALL SELECT n, 'form', {cardinal('n')} || '-образный' FROM n WHERE n > 0"
)
def roman_references(spark, sf_dir):
    kinds = [(f"{k}. ", f"{k}. {{}} тут") for k in C.REFERENCES] + [("stop", "LCD, MIX, DIV"), ("ruler", "Пётр {}"), ("dash", "{}-б"), ("form", "{}-образный")]
    rows = _frames(spark, sf_dir, kinds, ["kind", "spoken"]).withColumn("spoken", F.replace("spoken", F.lit("{}"), N.to_roman(F.col("n"))))
    return rows.withColumn("spoken", STEPS["17b"](F.col("spoken")))


# --- step 17: rulers ------------------------------------------------------------------------------------------------------------------------
def _ruler_rows() -> list[tuple]:
    """(name as written, case of the numeral): the first case in the order of the rules that has the form."""
    out = {}
    for name, (gender, nom, gen, dat, acc, ins, prep) in DEFAULTS.rulers.items():
        sex = "f" if gender == "fem" else "m"
        for form, case in ((nom, f"nom_{sex}"), (gen, "gen"), (acc, f"acc_{sex}"), (dat, "dat"), (ins, "instr"), (prep, "prep"), (name, f"nom_{sex}")):
            out.setdefault(form.replace(L.ACUTE, ""), case)
    return [*out.items(), ("Иван", None)]


@query(f"WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part), u AS (SELECT * FROM {_values(_ruler_rows(), 'name, kase')}) SELECT n, name, 'При ' || name || ' ' || coalesce({_cases({c: ordinal99('n', c) for c in t.CASES}, 'kase')}, {words_list(ROMANS)}[n + 1]) || ',' AS spoken FROM n, u")
def ruler_names(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(name,) for name, _ in _ruler_rows()], ["name"])
    return rows.withColumn("spoken", F.concat(F.lit("При "), "name", F.lit(" "), N.to_roman(F.col("n")), F.lit(","))).withColumn("spoken", STEPS["17"](F.col("spoken")))


# --- step 18: letters with digits -----------------------------------------------------------------------------------------------------------
_CODES = {
    "А{}": "'а́ ' || #", "АБВ{}": "'а́-бэ́-вэ́ ' || #", "Ми{} нет": "'э́м-и́ ' || # || ' нет'", "{}Д": "# || ', дэ́'", "{}ГАЗ": "# || ', гэ́-а́-зэ́'", "{}км": "n || 'км'", "дом{}": "'дом' || n",
    "А. Б. Иванов {}": "'а́-бэ́, Иванов ' || n", "Ж. вот {}": "'жэ́. вот ' || n", "Ж., вот {}": "'жэ́, вот ' || n", "в. дом {}": "'в. дом ' || n", "а-б {}": "'а-б ' || n", "Q-W {}": "'кью́-да́бл ю́ ' || n", "А-{}": "'А-' || n", "{} Z": "n || ' Z'",
}


@query("WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) " + " UNION ALL ".join(f"SELECT n, {quote(k)} AS kind, {v.replace('#', cardinal('n'))} AS spoken FROM n" for k, v in _CODES.items()))
def alphanumeric_codes(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(k, k) for k in _CODES], ["kind", "spoken"]).withColumn("spoken", F.replace("spoken", F.lit("{}"), F.col("n").cast("string")))
    return rows.withColumn("spoken", STEPS["18"](F.col("spoken")))


# --- dictionaries -----------------------------------------------------------------------------------------------------------------------------
_WORDS = Dictionaries(ru={"ВВС": "", "СМЕРШ": "сме́рш"}, en={"NATO": "nato|нато", "USA": "u s a", "XL": "large", "GPS": "", "R&D": "r and d|эр энд ди", "UFO": "|нло"})
_READ_AS = {
    "ВВС {}": "'вэ́ вэ́ э́с ' || n", "СМЕРШ, {}": "'сме́рш, ' || n", "блок NATO {}": "'блок нато ' || n", "NATO ship {}": "'nato ship ' || n", "{} NATO!": "n || ' nato!'", "USA и {}": "'u s a и ' || n", "XL, GPS {}": "'XL, GPS ' || n", "R&D – {}": "'r and d – ' || n", "отдел (R&D) {}": "'отдел (эр энд ди) ' || n",
    "UFO {}": "'нло ' || n", "ВВС, NATO {}": "'вэ́ вэ́ э́с, нато ' || n", "NATOX {}": "'NATOX ' || n",
    "слово" + " ,.-" * 40 + "NATO {}": "'слово" + " ,.-" * 40 + "нато ' || n",
}


@query("WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) " + " UNION ALL ".join(f"SELECT n, {i} AS kind, {v} AS spoken FROM n" for i, v in enumerate(_READ_AS.values())))
def acronyms(spark, sf_dir):
    own = steps(_WORDS)
    rows = _frames(spark, sf_dir, [(str(i), k) for i, k in enumerate(_READ_AS)], ["kind", "spoken"]).withColumn("kind", F.col("kind").cast("int"))
    rows = rows.withColumn("spoken", F.replace("spoken", F.lit("{}"), F.col("n").cast("string")))
    return rows.withColumn("spoken", own["16"](F.col("spoken"))).withColumn("spoken", own["20"](F.col("spoken")))


@query("SELECT n_nationkey, 'пост скри́птум ' || n_name || ' эт цетера, P.S.а' AS spoken FROM nation")
def substitutions(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", STEPS["3"](F.concat(F.lit("P.S. "), "n_name", F.lit(" etc., P.S.а"))).alias("spoken"))


_TAGGED = {
    "слово the house of J. K., да {}": "'слово <tts_en>the house of J. kay,</tts_en> да ' || n", "ab да {}": "'ab да ' || n", "vitamin C {}": "'<tts_en>vitamin see</tts_en> ' || n", "BBC и {}": "'<tts_en>би́ би́ си́</tts_en> и ' || n", "Mädchen, {}": "'<tts_en>Madchen,</tts_en> ' || n", "рок'n'roll {}": "'рок''<tts_en>n''roll</tts_en> ' || n",
}


@query("WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) " + " UNION ALL ".join(f"SELECT n, {i} AS kind, {v} AS spoken FROM n" for i, v in enumerate(_TAGGED.values())))
def language_tags(spark, sf_dir):
    rows = _frames(spark, sf_dir, [(str(i), k) for i, k in enumerate(_TAGGED)], ["kind", "spoken"]).withColumn("kind", F.col("kind").cast("int"))
    return rows.withColumn("spoken", F.replace("spoken", F.lit("{}"), F.col("n").cast("string"))).withColumn("spoken", STEPS["28"](F.col("spoken")))


# --- Greek ------------------------------------------------------------------------------------------------------------------------------------
@query(f"WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) SELECT n, {words_list(L.GREEK.values())}[n % 25 + 1] AS spoken, {words_list(L.GREEK_NAMES[g] for g in L.GREEK)}[n % 25 + 1] || '. да' AS named FROM n")
def greek_letters(spark, sf_dir):
    glyph = F.get(F.array(*map(F.lit, L.GREEK)), (F.col("n") % 25).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct().withColumns({"spoken": glyph, "named": F.concat(glyph, F.lit(". да"))})
    return rows.select("n", STEPS["27"](F.col("spoken")).alias("spoken"), STEPS["27"](F.col("named")).alias("named"))
