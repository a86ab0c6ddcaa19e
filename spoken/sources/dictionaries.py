"""Dictionaries: the built-in defaults, and readers and writers of their text form (gzip by file name)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dictionary becomes a literal of the plan, so its size is checked; the bound is far above a hand-made dictionary.
MAX_ENTRIES = 200_000


@dataclass(frozen=True)
class Dictionaries:
    """``ru``: acronym to what is said (empty: its letters). ``en``: acronym to ``en``, ``en|ru`` or empty. ``patterns``: regular
    expression to replacement, in order. ``rulers``: name to gender (mas, fem) and the forms nom, gen, dat, acc, ins, prep."""

    ru: dict[str, str] = field(default_factory=dict)
    en: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    rulers: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if max(map(len, (self.ru, self.en, self.patterns, self.rulers))) > MAX_ENTRIES:
            raise ValueError(f"a dictionary has more than {MAX_ENTRIES} entries")


# --- fixed values: the dictionaries that apply unless others are given ------------------------------------------------------------------
DEFAULTS = Dictionaries(
    ru={"ВВС": "", "СВТ": "эс вэ тэ", "НКВД": "эн ка вэ дэ", "СМЕРШ": "сме́рш"},
    en={"BBC": "", "GPS": "", "CPU": "си пи ю", "GPU": "джи пи ю"},
    patterns={r"\bP\.S\.(?![а-яё\w])": "пост скри́птум", r"\betc\.(?![а-яё\w])": "эт цетера"},
    rulers={"Пётр": ("mas", "Пё́тр", "Петра́", "Петру́", "Петра́", "Петро́м", "Петре́"), "Екатерина": ("fem", "Екатери́на", "Екатери́ны", "Екатери́не", "Екатери́ну", "Екатери́ной", "Екатери́не")},
)


def load(spark: SparkSession, ru: str | None = None, en: str | None = None, patterns: str | None = None, rulers: str | None = None) -> Dictionaries:
    """Dictionaries from text files; the defaults stand in for those without a path. Broken patterns are left out."""
    found = {}
    if ru:
        found["ru"] = {r["key"]: r["ru"] for r in read_acronyms(spark, ru, "ru").limit(MAX_ENTRIES + 1).collect()}
    if en:
        found["en"] = {r["key"]: f"{r['en']}|{r['ru']}" if r["ru"] is not None else r["en"] for r in read_acronyms(spark, en, "en").limit(MAX_ENTRIES + 1).collect()}
    if patterns:
        rows = spark.read.text(patterns).filter("trim(value) <> '' and not startswith(trim(value), '#')").limit(MAX_ENTRIES + 1).collect()
        found["patterns"] = {k.strip(): v.strip() for k, _, v in (r["value"].rpartition("=") for r in rows)}
    if rulers:
        rows = read_rulers(spark, rulers).groupBy("base", "gender").pivot("case", ["nom", "gen", "dat", "acc", "ins", "prep"]).agg(F.first("form")).limit(MAX_ENTRIES + 1).collect()
        found["rulers"] = {r["base"]: tuple(r)[1:] for r in rows}
    return Dictionaries(**{k: getattr(DEFAULTS, k) for k in ("ru", "en", "patterns", "rulers")} | found)


def java_pattern(pattern: str) -> str | None:
    """A pattern of a dictionary for Java: word bounds at its ends know Cyrillic letters and marks. None if it is broken."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    bound = r"[а-яё\ẁ-ͯ]"
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{bound}){pattern[2:]}"
    if pattern.endswith(r"\b"):
        pattern = f"{pattern[:-2]}(?!{bound})"
    return "(?U)" + pattern.replace("(?P<", "(?<")


def read_acronyms(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, key, en, ru) of lines ``KEY = SAY``, ``KEY=SAY`` or ``KEY``; in an English dictionary also ``KEY = EN = RU``. Blank lines and
    # are skipped, and so are lines with an empty key or an empty reading after a sign. With blanks around it, the first sign divides
    key and reading, without, the last; a reading may hold more of them. Files may be compressed."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line")).filter("line <> '' and not startswith(line, '#')")
    part = lambda pattern, i: F.trim(F.regexp_extract("line", pattern, i))
    spaced, tight, three = "^(.*?) = (.*)$", "^(.*)=(.*)$", "^([^=]*)=([^=]*)=(.*)$"
    triple = F.lit(lang == "en") & F.col("line").rlike(three)
    divided = F.col("line").rlike("=")
    key = F.when(triple, part(three, 1)).when(F.col("line").rlike(spaced), part(spaced, 1)).when(divided, part(tight, 1)).otherwise(F.col("line"))
    said = F.when(triple, part(three, 2)).when(F.col("line").rlike(spaced), part(spaced, 2)).when(divided, part(tight, 2)).otherwise("")
    other = F.when(triple, part(three, 3))
    rows = lines.select(F.lit(lang).alias("lang"), key.alias("key"), said.alias("said"), other.alias("other"), (divided & ~triple).alias("pair")).filter("key <> '' and not (pair and said = '')")
    own = [F.col("said").alias("en"), F.col("other").alias("ru")] if lang == "en" else [F.lit(None).cast("string").alias("en"), F.col("said").alias("ru")]
    return rows.select("lang", "key", *own)


def read_rulers(spark: SparkSession, path: str) -> DataFrame:
    """(base, gender, case, form) in long form of lines ``gender base nom gen dat acc ins prep``."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.size(parts) >= 8)).select(parts.alias("p"))
    cases = ("nom", "gen", "dat", "acc", "ins", "prep")
    pairs = F.array(*(F.struct(F.lit(c).alias("case"), F.get("p", F.lit(i + 2)).alias("form")) for i, c in enumerate(cases)))
    return rows.select(F.get("p", F.lit(1)).alias("base"), F.get("p", F.lit(0)).alias("gender"), F.inline(pairs))


def write_acronyms(dictionary: DataFrame, path: str) -> None:
    """Writes (lang, key, en, ru) in the form that ``read_acronyms`` reads, sorted, compressed."""
    parts = F.when(F.col("lang") == "en", F.array("key", "en", "ru")).otherwise(F.array("key", "ru"))
    line = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " = ")
    dictionary.orderBy("key").select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_rulers(rulers: DataFrame, path: str) -> None:
    """Writes (base, gender, case, form) in the form that ``read_rulers`` reads, sorted, compressed."""
    cases = ["nom", "gen", "dat", "acc", "ins", "prep"]
    wide = rulers.groupBy("base", "gender").pivot("case", cases).agg(F.first("form"))
    wide.orderBy("base").select(F.concat_ws(" ", "gender", "base", *cases).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
