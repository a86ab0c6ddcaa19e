"""The registered queries of the normalization engine, each with its DuckDB counterpart: numerals, text steps, tokens, speech. Rules that
look at context are in ``catalog_rules``, reports in ``catalog_reports``, books in ``catalog_books``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import numerals as N
from ..functions import tables as t
from ..operators import speech, tokens
from ..operators.steps import STEPS
from . import pipeline
from .sql import QUERIES, SQL, Query, cardinal, feminine, ordinal99, plural, query, quote, read, replace_all, under_thousand, words_list

# --- numerals -------------------------------------------------------------------------------------------------------------------------
@query(f"SELECT p_partkey, {cardinal('p_partkey')} AS words FROM part")
def cardinal_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", N.cardinal(F.col("p_partkey")).alias("words"))


@query(f"SELECT l_orderkey * 7919 + 1000000 AS n, {cardinal('(l_orderkey * 7919 + 1000000)')} AS words FROM lineitem")
def cardinal_large(spark, sf_dir):
    n = F.col("l_orderkey") * 7919 + 1000000
    return read(spark, sf_dir, "lineitem").select(n.alias("n"), N.cardinal(n).alias("words"))


@query("WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) " + " UNION ALL ".join(f"SELECT n, '{c}' AS kase, {ordinal99('n', c)} AS words FROM n" for c in t.CASES))
def ordinal_words_12_cases(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("kase"), N.ordinal(F.col("n"), c).alias("words")) for c in t.CASES))))


@query(f"SELECT {plural('l_quantity::BIGINT', t.MINUTE)} AS noun, {feminine(under_thousand('(l_quantity::BIGINT)'))} AS count_words, count(*) AS n FROM lineitem GROUP BY 1, 2")
def plural_agreement(spark, sf_dir):
    n = F.col("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(N.plural(n, t.MINUTE).alias("noun"), N.feminine(N.cardinal(n)).alias("count_words")).agg(F.count("*").alias("n"))


_ROMANS = [a + b for a in ("", "X", "XX", "XXX", "XL", "L") for b in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]


@query(f"SELECT p_partkey, {words_list(_ROMANS)}[p_size + 1] AS roman, p_size AS back, true AS valid FROM part")
def roman_roundtrip(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("roman", N.to_roman(F.col("p_size")))
    return part.select("p_partkey", "roman", N.roman_to_int(F.col("roman")).alias("back"), N.is_valid_roman(F.col("roman")).alias("valid"))


@query(f"SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ''), lambda c: coalesce(MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in t.LETTERS.items())}}}[c], c)), '-') AS spelled FROM nation")
def spell_letters(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", N.spell(F.col("n_name")).alias("spelled"))


def _money_sql(amount: str, code: str) -> str:
    (main, fem), (sub, sub_fem), *_ = t.CURRENCIES[code]
    whole, cents = f"({amount} // 100)", f"({amount} % 100)"
    agree = lambda w, f: feminine(w) if f else w
    return f"concat_ws(' ', {agree(cardinal(whole), fem)}, {plural(whole, main)}, CASE WHEN {cents} > 0 THEN {agree(cardinal(cents), sub_fem)} || ' ' || {plural(cents, sub)} END)"


@query(f"WITH o AS (SELECT o_orderpriority, (sum((o_totalprice * 100)::DECIMAL(20, 0)))::BIGINT AS c FROM orders GROUP BY 1) SELECT o_orderpriority, {_money_sql('c', 'rub')} AS spoken FROM o")
def spoken_totals(spark, sf_dir):
    cents = F.sum((F.col("o_totalprice") * 100).cast("decimal(20,0)")).cast("long")
    sums = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(cents.alias("c"))
    return sums.select("o_orderpriority", N.money((F.col("c").cast("decimal(20,0)") / 100).cast("decimal(20,2)"), "rub").alias("spoken"))


@query(f"WITH c AS (SELECT c_custkey, (abs(c_acctbal) * 100)::DECIMAL(18, 0)::BIGINT AS c FROM customer) SELECT c_custkey, {_money_sql('c', 'uah')} AS spoken FROM c")
def spoken_money(spark, sf_dir):
    amount = ((F.abs("c_acctbal") * 100).cast("decimal(18,0)") / 100).cast("decimal(20,2)")
    return read(spark, sf_dir, "customer").select("c_custkey", N.money(amount, "uah").alias("spoken"))


# --- text steps -----------------------------------------------------------------------------------------------------------------------
def _step(name: str, text) -> object:
    return STEPS[name](text)


@query(f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d::VARCHAR AS day, {ordinal99('day(d)', 'gen')} || ' ' || {words_list(t.MONTHS)}[month(d)] || ' ' || {cardinal('year(d)')} || ' го́да' AS spoken FROM d")
def spoken_dates(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("text", F.date_format("d", "dd.MM.yyyy"))
    return days.select(F.col("d").cast("string").alias("day"), _step("8", F.col("text")).alias("spoken"))


@query(f"WITH e AS (SELECT DISTINCT hour(ts) AS h, minute(ts) AS m FROM events) SELECT h || ':' || lpad(m::VARCHAR, 2, '0') AS at, concat_ws(' ', CASE WHEN h = 1 THEN 'ча́с' ELSE {cardinal('h')} || ' ' || {plural('h', t.HOUR)} END, CASE WHEN m > 0 THEN {feminine(cardinal('m'))} || ' ' || {plural('m', t.MINUTE)} END) AS spoken FROM e")
def spoken_times(spark, sf_dir):
    at = read(spark, sf_dir, "events").select(F.concat(F.hour("ts").cast("string"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0")).alias("at")).distinct()
    return at.select("at", _step("10", F.col("at")).alias("spoken"))


@query(f"WITH l AS (SELECT round(l_discount * 100)::BIGINT AS n, count(*) AS c FROM lineitem GROUP BY 1) SELECT {cardinal('n')} || ' ' || {plural('n', t.PERCENT)} AS spoken, c FROM l")
def spoken_percent(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%")).alias("text")).agg(F.count("*").alias("c"))
    return n.select(_step("12", F.col("text")).alias("spoken"), "c")


@query(f"WITH e AS (SELECT event_id, floor(abs(value) * 100)::BIGINT AS v FROM events), f AS (SELECT event_id, v // 100 AS w, v % 100 AS p FROM e) SELECT event_id, CASE WHEN p = 0 THEN {cardinal('w')} ELSE {feminine(cardinal('w'))} || CASE WHEN w % 10 = 1 AND w % 100 <> 11 THEN ' це́лая' ELSE ' це́лых' END || ' и́ ' || {feminine(cardinal('p'))} || ' со́тых' END AS spoken FROM f")
def spoken_decimals(spark, sf_dir):
    v = F.floor(F.abs("value") * 100).cast("long")
    text = F.concat(F.floor(v / 100).cast("string"), F.lit(","), F.lpad((v % 100).cast("string"), 2, "0"))
    return read(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", _step("22", F.col("text")).alias("spoken"))


def _sizes(spark, sf_dir, text):
    return read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct().withColumn("text", text)


_N = "WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) SELECT n, "


def _variants(spark, sf_dir, pairs: list[tuple[str, str]]):
    """(n, kind, text): every size in every frame, whose braces stand for the number."""
    sizes = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    frames = F.array(*(F.struct(F.lit(kind).alias("kind"), F.replace(F.lit(frame), F.lit("{}"), F.col("n").cast("string")).alias("text")) for kind, frame in pairs))
    return sizes.select("n", F.inline(frames))


def _each(expected: dict[str, str]) -> str:
    """SQL for (n, kind, spoken) from the expected words of each kind."""
    return "WITH n AS (SELECT DISTINCT p_size::BIGINT AS n FROM part) " + " UNION ALL ".join(f"SELECT n, {quote(kind)} AS kind, {words} AS spoken FROM n" for kind, words in expected.items())


@query(_each({s: ordinal99("n", c) for s, c in t.SUFFIXES.items()}))
def ordinal_suffixes(spark, sf_dir):
    return _variants(spark, sf_dir, [(s, "{}-" + s) for s in t.SUFFIXES]).select("n", "kind", _step("15", F.col("text")).alias("spoken"))


def _counted_words(forms, fem: bool) -> str:
    return f"{feminine(cardinal('n')) if fem else cardinal('n')} || ' ' || {plural('n', forms)}"


@query(_each({k: f"{_counted_words(*v)} || '.'" for k, v in t.MULTIPLIERS.items()}))
def multipliers(spark, sf_dir):
    return _variants(spark, sf_dir, [(k, "{} " + k + ".") for k in t.MULTIPLIERS]).select("n", "kind", _step("13", F.col("text")).alias("spoken"))


@query(_each({k: f"'около ' || {_counted_words(*v)} || ', да'" for k, v in t.MEASURES.items()}))
def measurements(spark, sf_dir):
    return _variants(spark, sf_dir, [(k, "около {} " + k + ", да") for k in t.MEASURES]).select("n", "kind", _step("14a", F.col("text")).alias("spoken"))


@query(_each({k: _counted_words(*v) for k, v in t.AMBIGUOUS.items()}))
def ambiguous_measurements(spark, sf_dir):
    return _variants(spark, sf_dir, [(k, "{} " + k) for k in t.AMBIGUOUS]).select("n", "kind", _step("14b", F.col("text")).alias("spoken"))


_CENTS = {code: f"{_counted_words(*x[0])} || ' ' || {feminine(under_thousand('25')) if x[1][1] else under_thousand('25')} || ' ' || {plural('25', x[1][0])}" for code, x in t.CURRENCIES.items()}


@query(_each({f"{code} after": _counted_words(*x[0]) for code, x in t.CURRENCIES.items()} | {f"{code} before": _counted_words(*x[0]) for code, x in t.CURRENCIES.items() if x[4]} | {f"{code} cents": _CENTS[code] for code in t.CURRENCIES}))
def currency_signs(spark, sf_dir):
    frames = [(f"{code} after", "{} " + x[3]) for code, x in t.CURRENCIES.items()] + [(f"{code} before", x[4] + "{}") for code, x in t.CURRENCIES.items() if x[4]] + [(f"{code} cents", "{}.25" + x[3]) for code, x in t.CURRENCIES.items()]
    return _variants(spark, sf_dir, frames).select("n", "kind", _step("23", F.col("text")).alias("spoken"))


@query(_N + f"CASE n WHEN 1 THEN 'одно́' WHEN 2 THEN 'дву́х' WHEN 3 THEN 'трё́х' WHEN 4 THEN 'четырё́х' ELSE regexp_replace(list_extract(string_split({cardinal('n')}, ' '), -1), 'ть$', 'ти') END || 'летний' AS spoken FROM n")
def compound_adjectives(spark, sf_dir):
    return _sizes(spark, sf_dir, F.concat("n", F.lit("-летний"))).select("n", _step("9", F.col("text")).alias("spoken"))


@query(_each({p: f"{cardinal('n')} || ' и {said} летний'" for p, said in (("5", "пя́ть деся́тых"), ("25", "два́дцать пя́ть со́тых"), ("125", "сто́ два́дцать пя́ть ты́сячных"))}))
def decimal_hyphens(spark, sf_dir):
    return _variants(spark, sf_dir, [(p, "{}," + p + "-летний") for p in ("5", "25", "125")]).select("n", "kind", _step("8.5", F.col("text")).alias("spoken"))


@query(_each({k: f"'см. {v} ' || n || ', ' || n" for k, v in t.SECTIONS.items()}))
def section_names(spark, sf_dir):
    return _variants(spark, sf_dir, [(k, "см. " + (k if i % 2 else k.capitalize()) + ("." if i % 3 else ". ") + "{}, {}") for i, k in enumerate(t.SECTIONS)]).select("n", "kind", _step("5", F.col("text")).alias("spoken"))


@query(f"WITH f AS (SELECT * FROM (VALUES {', '.join(f'({quote(k)}, {a}, {b})' for k, (a, b) in t.FRACTIONS.items())}) AS v(glyph, num, den)) SELECT glyph, count(*) AS n, 'там ' || any_value(CASE num WHEN 0 THEN {quote(t.ZERO)} ELSE {feminine(under_thousand('num'))} END || ' ' || CASE WHEN num = 1 THEN {ordinal99('den', 'nom_f')} ELSE {ordinal99('den', 'pl')} END) || '.' AS spoken FROM part, f WHERE glyph = {words_list(t.FRACTIONS)}[p_size % 19 + 1] GROUP BY 1")
def vulgar_fractions(spark, sf_dir):
    glyph = F.get(F.array(*map(F.lit, t.FRACTIONS)), F.col("p_size") % 19)
    rows = read(spark, sf_dir, "part").groupBy(glyph.alias("glyph")).agg(F.count("*").alias("n"))
    return rows.withColumn("spoken", F.concat(F.lit("там "), "glyph", F.lit("."))).select("glyph", "n", _step("11", F.col("spoken")).alias("spoken"))


@query("SELECT o_orderkey, (o_orderkey + 1000000)::VARCHAR AS spoken FROM orders")
def digit_groups(spark, sf_dir):
    n = (F.col("o_orderkey") + 1000000).cast("string")
    text = F.regexp_replace(n, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", _step("6", F.col("text")).alias("spoken"))


@query("SELECT s_suppkey, regexp_replace('(' || floor(s_acctbal)::INT || ') ' || floor(s_acctbal)::INT, '(^|[\\s(\\[])[-−](\\d)', '\\1ми́нус \\2', 'g') AS spoken FROM supplier")
def negative_numbers(spark, sf_dir):
    n = F.floor("s_acctbal").cast("int").cast("string")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("("), n, F.lit(") "), n).alias("text")).select("s_suppkey", _step("24", F.col("text")).alias("spoken"))


@query("SELECT doc_id, regexp_replace(" + replace_all("text", {k: f" {t.SYMBOLS[k]} " for k in sorted(t.SYMBOLS, key=lambda s: -len(s))}) + ", ' {2,}', ' ', 'g') AS spoken FROM documents")
def symbol_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _step("21", F.col("text")).alias("spoken"))


@query("SELECT doc_id, regexp_replace(" + replace_all("regexp_replace(text, '\\*\\*|__|`', '', 'g')", t.TYPOGRAPHY) + ", '([аеёиоуыэюяАЕЁИОУЫЭЮЯ])\\+', '\\1\u0301', 'g') AS plain FROM documents")
def typography(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _step("1", F.col("text")).alias("plain"))


@query("SELECT page_id, regexp_replace(trim(regexp_replace(" + replace_all("regexp_replace(url, '[.,!?]+$', '')", t.WEB) + ", ' {2,}', ' ', 'g')), '#([A-Za-zА-Яа-яёЁ0-9_]+)', 'хештег \\1', 'g') AS spoken FROM pages")
def web_addresses(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", _step("2", F.col("url")).alias("spoken"))


@query("SELECT doc_id, " + replace_all("text", L.latin_letters()) + " AS plain FROM documents")
def latin_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _step("29", F.col("text")).alias("plain"))


# --- tokens and reports -----------------------------------------------------------------------------------------------------------------
_TOKEN = tokens.TOKEN


@query(f"SELECT doc_id, len(regexp_extract_all(text, {quote(_TOKEN)})) AS n_words, len(regexp_extract_all(text, {quote(_TOKEN)})) + 1 AS n_gaps, text AS back FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tokens.words(F.col("text")).alias("w"), tokens.gaps(F.col("text")).alias("g"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size("g").cast("long").alias("n_gaps"), tokens.join(F.col("w"), F.col("g")).alias("back"))


@query(f"SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, {quote(_TOKEN)})) AS token FROM documents) GROUP BY 1 ORDER BY cnt DESC, token LIMIT 20")
def token_topk(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.explode(tokens.words(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(20)


@query("SELECT DISTINCT 'en' AS lang, token FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z_\\p{L}\\p{M}]+')) AS token FROM documents) WHERE regexp_full_match(token, '[A-Z]{2,}') AND token NOT IN ('THE', 'AND')")
def unknown_acronyms(spark, sf_dir):
    known = spark.createDataFrame([("en", "THE"), ("en", "AND")], "lang string, key string")
    return pipeline.unknown_acronyms(read(spark, sf_dir, "documents"), known)


@query()
def normalized_documents(spark, sf_dir):
    return pipeline.normalize(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, md5(text) AS source_md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def incremental_skip(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    log = docs.filter("doc_id % 2 = 0").select(F.md5(F.col("text").cast("binary")).alias("source_md5"))
    return pipeline.new_texts(docs, log).select("doc_id", "source_md5")


# --- speech plan ------------------------------------------------------------------------------------------------------------------------
_DIRTY = "'«' || {0} || '» … — “x” // /* e' || chr(769) || ' &amp;lt; &nbsp;&mdash;'"


def _clean_sql(text: str) -> str:
    out = replace_all(f"nfc_normalize({text})", speech.REPLACED)
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\p{{Z}}\\p{{M}}\\p{{P}}+-]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_clean_sql('text')} AS clean, {_clean_sql(_DIRTY.format('lang'))} AS dirty FROM documents")
def clean_for_tts(spark, sf_dir):
    dirty = F.concat(F.lit("«"), "lang", F.lit("» … — “x” // /* e\u0301 &amp;lt; &nbsp;&mdash;"))
    return read(spark, sf_dir, "documents").select("doc_id", speech.clean_for_tts(F.col("text")).alias("clean"), speech.clean_for_tts(dirty).alias("dirty"))


@query(f"WITH w AS (SELECT p_partkey, {cardinal('p_partkey')} AS w FROM part) SELECT p_partkey, regexp_replace(w, '([{speech.VOWELS}])\u0301', '\\1', 'g') AS auto, regexp_replace(w, '([{speech.VOWELS}])\u0301', '+\\1', 'g') AS manual FROM w")
def stress_marks(spark, sf_dir):
    w = N.cardinal(F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", speech.convert_stress(w, "auto").alias("auto"), speech.convert_stress(w, "manual").alias("manual"))


@query("SELECT o_orderkey, unnest([{'lang': 'ru', 'text': 'да'}, {'lang': 'en', 'text': o_orderpriority}, {'lang': 'ru', 'text': 'нет'}], recursive := true) FROM orders")
def language_split(spark, sf_dir):
    text = F.concat(F.lit("да <tts_en>"), "o_orderpriority", F.lit("</tts_en> нет"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.inline(speech.split_by_language(text)))


@query("SELECT conv_id, turn, CASE right(rtrim(text), 1) WHEN '.' THEN 0.05 WHEN '!' THEN 0.05 WHEN '?' THEN 0.05 WHEN '…' THEN 0.05 WHEN ';' THEN 0.1 WHEN ':' THEN 0.12 WHEN ',' THEN 0.05 WHEN '-' THEN 0.2 WHEN '–' THEN 0.2 WHEN '—' THEN 0.2 ELSE 0.0 END::DOUBLE AS pause FROM conversations")
def pause_plan(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", speech.pause_after(F.col("text")).alias("pause"))


@query("SELECT n_nationkey, 'чина квест дабл ю дабл ю дабл ю ' || n_nationkey AS spoken FROM nation")
def transliteration(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", speech.transliterate(F.concat(F.lit("China quest WWW "), "n_nationkey")).alias("spoken"))


@query("SELECT o_orderkey, unnest([{'text': o_orderpriority || ',', 'pause': 0.05::DOUBLE}, {'text': ' b:', 'pause': 0.12::DOUBLE}, {'text': ' c', 'pause': 0.0::DOUBLE}], recursive := true) FROM orders")
def forced_pauses(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit(",, b: c"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.inline(speech.forced_pauses(text)))


@query("SELECT n_nationkey, '<speak>' || replace(lower(n_name), 'nation', 'натион') || ' &amp; он,<break time=\"50ms\"/> да</speak>' AS ssml FROM nation")
def ssml(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", speech.ssml(F.concat(F.lower("n_name"), F.lit(" & он, да"))).alias("ssml"))


def _blocks(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "footnote").otherwise("text")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chapter_idx"), F.col("turn").alias("block_idx"), kind.alias("type"), F.col("text").alias("content"))


@query("SELECT conv_id AS doc_id, turn AS block_idx, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::INT AS part_idx FROM conversations")
def part_pagination(spark, sf_dir):
    return speech.paginate(_blocks(spark, sf_dir), 3).select("doc_id", "block_idx", "part_idx")


@query("WITH b AS (SELECT conv_id AS doc_id, turn AS block_idx, CASE WHEN role = 'assistant' THEN 'footnote' ELSE 'text' END AS type, text AS content, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS p FROM conversations), c AS (SELECT *, lead(type) OVER (PARTITION BY doc_id, p ORDER BY block_idx) AS next FROM b) SELECT doc_id, block_idx, CASE WHEN type = 'text' AND next = 'footnote' AND NOT regexp_matches(rtrim(content), '[.,;:!?…]$') AND length(trim(content)) > 0 THEN rtrim(content) || ',' ELSE content END AS content FROM c")
def forced_comma(spark, sf_dir):
    return speech.forced_comma(speech.paginate(_blocks(spark, sf_dir), 3)).select("doc_id", "block_idx", "content")


@query("SELECT c.conv_id AS doc_id, c.turn AS note_id, d.text AS note_text FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.turn = 1")
def footnote_join(spark, sf_dir):
    refs = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("note_id"))
    notes = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).cast("long").alias("note_id"), F.col("text").alias("note_text"), F.lit(0).alias("pos"))
    return speech.resolve_footnotes(refs, notes)


@query("SELECT label, round(avg(r), 6) AS rms, round(avg(g), 6) AS gain FROM (SELECT label, r, pow(10, -23.0 / 20) * 0.5 / r AS g FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r FROM embeddings)) GROUP BY 1")
def rms_gain(spark, sf_dir):
    level = read(spark, sf_dir, "embeddings").select("label", speech.rms(F.col("embedding")).alias("r"))
    return level.groupBy("label").agg(F.round(F.avg("r"), 6).alias("rms"), F.round(F.avg(speech.loudness_gain(F.col("r"))), 6).alias("gain"))


from . import catalog_books, catalog_reports, catalog_rules  # noqa: E402,F401  (they add to the register)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
