"""Queries of books: generated documents read into blocks, notes, parts and the timed script, with the rows that SQL expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import speech
from ..sources import books
from ..sources.fb2 import text_nodes
from ..sources.settings import DEFAULTS, Settings
from . import script
from .sql import cardinal, query, quote, read, strip

SAMPLE_FB2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>Анна</first-name><last-name>Рощина</last-name></author><book-title>Дом у реки</book-title></title-info></description><body><section><title><p>Глава 1</p></title><p>В 12:05 пришёл поезд<a type="note" l:href="#n1">[1]</a> из <emphasis>Твери</emphasis>, №7.</p><p>Осталось 5%.</p></section></body><body name="notes"><section id="n1"><title><p>1</p></title><p>Старый поезд.</p></section></body></FictionBook>"""
_HEAD, _TAIL = SAMPLE_FB2[: SAMPLE_FB2.index("<description>")], "</FictionBook>"
_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {quote(x)})" for i, (k, x) in enumerate([("text", "Анна"), ("text", "Рощина"), ("text", "Дом у реки"), ("text", "Глава 1"), ("text", "В 12:05 пришёл поезд"), ("text", "[1]"), ("tail", " из "), ("text", "Твери"), ("tail", ", №7."), ("text", "Осталось 5%."), ("text", "1"), ("text", "Старый поезд.")])) + ") AS v(node_idx, kind, text)")
def fb2_text_nodes(spark, sf_dir):
    files = spark.createDataFrame([("a.fb2", bytearray(SAMPLE_FB2.encode()))], "path string, content binary")
    return text_nodes(files).select("node_idx", "kind", "text")


def _xml(x):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def book_files(spark, sf_dir) -> DataFrame:
    """(path, content): a book for each conversation. Turns are sections, those of assistants without title; even ones have a note."""
    turns = read(spark, sf_dir, "conversations").withColumn("t", F.col("turn").cast("string"))
    text = _xml(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]", " "))
    told = F.concat(F.lit("<section><title><p>Глава "), "t", F.lit("</p></title><p>Т: "), text, F.lit('<a type="note" l:href="#n'), "t", F.lit('">['), "t", F.lit("]</a> после.</p><subtitle>Знак "), "t", F.lit("</subtitle><p>Ещё <emphasis>слова</emphasis>.</p><empty-line/></section>"))
    said = F.concat(F.lit("<section><p>Т: "), text, F.lit("</p><emphasis>Сильно</emphasis></section>"))
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<section id="n'), "t", F.lit('"><title><p>x</p></title><p>Сноска</p><p>номер '), "t", F.lit(".</p></section>"))).otherwise("")
    rows = turns.select("conv_id", F.struct("turn", F.when(F.col("role") == "assistant", said).otherwise(told).alias("body"), note.alias("note")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    own = F.col("conv_id").cast("string")
    front = F.concat(F.lit(_HEAD + "<description><title-info><author><first-name>Автор</first-name><last-name>"), own, F.lit("</last-name></author><book-title>Книга "), own, F.lit("?</book-title><annotation><p>О книге.</p></annotation></title-info></description><body><title><p>Начало</p></title>"))
    xml = F.concat(front, F.array_join(F.transform("xs", lambda x: x["body"]), ""), F.lit('</body><body name="notes">'), F.array_join(F.transform("xs", lambda x: x["note"]), ""), F.lit("</body>" + _TAIL))
    return whole.select(own.alias("path"), xml.cast("binary").alias("content"))


def _block(type_: str, content: str = "NULL", note: str = "NULL", title: str = "NULL", duration: str = "NULL") -> str:
    return f"{{'type': '{type_}', 'content': ({content})::VARCHAR, 'note_id': ({note})::VARCHAR, 'title': ({title})::VARCHAR, 'duration': ({duration})::DOUBLE}}"


def _text(words: str) -> str:
    return _block("text", words)


_SAID = f"nfc_normalize('Т: ' || regexp_replace(coalesce(text, ''), '{_CONTROL}', ' ', 'g'))"
_REST = f"[{_text(chr(39) + ' после.' + chr(39))}, {_block('pause', duration='0.8')}, {_text(chr(39) + 'Знак ' + chr(39) + ' || turn')}, {_block('pause', duration='0.4')}, {_text(quote('Ещё '))}, {_text(quote('слова'))}, {_text(quote('.'))}, {_block('pause', duration='0.5')}]"
_BLOCKS = f"""t AS (SELECT conv_id::VARCHAR AS doc_id, turn, role, text, 3 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chapter_idx FROM conversations),
b AS (SELECT doc_id, chapter_idx, CASE WHEN role = 'assistant' THEN [{_text(_SAID)}, {_block('emphasis', quote('Сильно'))}]
ELSE list_concat([{_text("'Глава ' || turn")}, {_block('pause', duration='0.4')}, {_text(_SAID)}], CASE WHEN turn % 2 = 0 THEN [{_block('footnote', note="'n' || turn", title="'[' || turn || ']'")}] ELSE [] END, {_REST}) END AS bs FROM t
UNION ALL SELECT DISTINCT doc_id, 0, [{_text("'Автор ' || doc_id || '.'")}] FROM t UNION ALL SELECT DISTINCT doc_id, 1, [{_text("'Книга ' || doc_id || '?'")}] FROM t
UNION ALL SELECT DISTINCT doc_id, 2, [{_text(quote('Аннотация'))}, {_text(quote('О книге.'))}, {_text(quote('Конец аннотации'))}] FROM t UNION ALL SELECT DISTINCT doc_id, 3, [{_text(quote('Начало'))}] FROM t),
blocks AS (SELECT doc_id, chapter_idx::INT AS chapter_idx, (i - 1)::INT AS block_idx, bs[i].type AS type, bs[i].content AS content, bs[i].note_id AS note_id, bs[i].title AS title, bs[i].duration AS duration FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM b))"""


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def fb2_blocks(spark, sf_dir):
    return books.book_blocks(book_files(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS doc_id, 'n' || turn AS note_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, 'Сноска номер ' || turn || '.' AS note_text FROM conversations WHERE turn % 2 = 0")
def fb2_notes(spark, sf_dir):
    return books.book_notes(book_files(spark, sf_dir))


@query(f"WITH {_BLOCKS} SELECT doc_id, chapter_idx, block_idx, type, CASE WHEN type = 'footnote' THEN 'Сноска номер ' || note_id[2:] || '.' ELSE content END AS content, title FROM blocks")
def footnotes(spark, sf_dir):
    files = book_files(spark, sf_dir)
    return script.with_notes(books.book_blocks(files), books.book_notes(files)).select("doc_id", "chapter_idx", "block_idx", "type", "content", "title")


_PAUSED = "paused AS (SELECT doc_id, chapter_idx, block_idx, type, content, duration FROM blocks UNION ALL SELECT doc_id, chapter_idx, (max(block_idx) + 1)::INT, 'pause', NULL, 1.5 FROM blocks GROUP BY ALL)"


@query(f"WITH {_BLOCKS}, {_PAUSED} SELECT doc_id, chapter_idx, block_idx, type, duration, ((row_number() OVER (PARTITION BY doc_id ORDER BY chapter_idx, block_idx) - 1) // 10)::INT AS part_idx FROM paused")
def chapter_parts(spark, sf_dir):
    every = script.with_chapter_pauses(books.book_blocks(book_files(spark, sf_dir)))
    return speech.paginate(every, 10).select("doc_id", "chapter_idx", "block_idx", "type", "duration", "part_idx")


@query(
    f"WITH {_BLOCKS}, g AS (SELECT doc_id, count(DISTINCT chapter_idx) AS chapters, count(*) AS blocks, count(*) FILTER (type = 'text') AS text_blocks, count(*) FILTER (type = 'footnote') AS footnotes, sum(length(content)) FILTER (type = 'text')::BIGINT AS chars, coalesce(sum(length(content)) FILTER (type = 'text' AND regexp_matches(content, '[a-zA-Z]')), 0)::BIGINT AS latin_chars FROM blocks GROUP BY 1) "
    "SELECT *, round(100.0::DOUBLE * latin_chars / greatest(1, chars), 1) AS latin_pct, round(100.0::DOUBLE * (chars - latin_chars) / greatest(1, chars), 1) AS cyrillic_pct, ceil(blocks / 100.0)::BIGINT AS parts, ceil((blocks + chapters) / 100.0)::BIGINT AS parts_with_pauses FROM g"
)
def book_profile(spark, sf_dir):
    return script.profile(books.book_blocks(book_files(spark, sf_dir)))


# --- joined blocks ------------------------------------------------------------------------------------------------------------------------
def _turn_blocks(spark, sf_dir) -> DataFrame:
    """Turns of a conversation as blocks of texts short and long, finished or not, with footnotes and pauses among them."""
    n, turn = F.col("conv_id") * 7 + F.col("turn"), F.col("turn")
    kind = F.when(turn % 7 == 5, "pause").when(turn % 5 == 3, "footnote").otherwise("text")
    ends = F.get(F.array(*map(F.lit, ("", ".", "", ",", " ", "!"))), (n % 6).cast("int"))
    text = F.concat(F.when(n % 4 == 1, ", ").otherwise(" "), F.left(F.translate("text", "\n\t\r", "   "), (n % 5 * 20 + 3).cast("int")), ends)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("type"), F.when(kind == "text", text).otherwise(F.lit("x")).alias("content"))
    own = Window.partitionBy("doc_id").orderBy("t")
    more = rows.unionByName(rows.withColumn("turn", F.col("turn") + 1000))  # twice as long
    blocks = more.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("t"), "type", "content").withColumn("block_idx", F.row_number().over(own))
    return blocks.select("doc_id", F.lit(0).alias("chapter_idx"), "block_idx", "type", "content")


_TURNS = """r AS (SELECT conv_id, turn, conv_id * 7 + turn AS n, CASE WHEN turn % 7 = 5 THEN 'pause' WHEN turn % 5 = 3 THEN 'footnote' ELSE 'text' END AS type, text FROM conversations),
e AS (SELECT conv_id, turn, type, CASE WHEN type = 'text' THEN CASE WHEN n % 4 = 1 THEN ', ' ELSE ' ' END || left(translate(text, chr(10) || chr(9) || chr(13), '   '), (n % 5 * 20 + 3)::INT) || ['', '.', '', ',', ' ', '!'][n % 6 + 1] ELSE 'x' END AS content FROM r),
w AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS block_idx, type, content FROM (SELECT conv_id, turn AS t, type, content FROM e UNION ALL SELECT conv_id, turn + 1000, type, content FROM e)),
p AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1) // 8)::INT AS part_idx FROM w)"""
_LOOSE = f"(type = 'text' AND (length({strip('content')}) < 50 OR regexp_matches({strip('content')}, '^[.,;:!?…]')) AND NOT regexp_matches({strip('content')}, '[.!?…]$'))"
_OPEN = "(s.type = 'text' AND NOT regexp_matches(regexp_replace(s.content, '\\s+$', ''), '[.!?…]$'))"
_LEFT = "CASE WHEN s.taking THEN regexp_replace(s.content, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(s.content, '\\s+$', '') END"


@query(
    f"""WITH RECURSIVE {_TURNS},
f AS (SELECT *, row_number() OVER o AS k, {_LOOSE} AS loose, {_LOOSE} AND lead(type) OVER o = 'text' AND coalesce(lead(type, 2) OVER o, '') <> 'pause' AS takes FROM p WINDOW o AS (PARTITION BY doc_id, part_idx ORDER BY block_idx)),
s AS (SELECT doc_id, part_idx, k, block_idx, type, content, coalesce(takes, false) AS taking, k AS first FROM f WHERE k = 1
UNION ALL SELECT f.doc_id, f.part_idx, f.k, CASE WHEN j THEN s.block_idx ELSE f.block_idx END, CASE WHEN j THEN s.type ELSE f.type END,
CASE WHEN j THEN {_LEFT} || CASE WHEN regexp_matches({_LEFT}, '[.,;:!?…]$') OR regexp_matches({strip('f.content')}, '^[.,;:!?…]') THEN '' ELSE ' ' END || {strip('f.content')} ELSE f.content END,
NOT j AND coalesce(f.takes, false), CASE WHEN j THEN s.first ELSE f.k END
FROM s JOIN f ON f.doc_id = s.doc_id AND f.part_idx = s.part_idx AND f.k = s.k + 1, LATERAL (SELECT (s.taking OR (f.loose AND {_OPEN})) AS j) AS q)
SELECT doc_id, part_idx, block_idx, type, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part_idx, first ORDER BY k DESC) AS z FROM s) WHERE z = 1"""
)
def block_merge(spark, sf_dir):
    return speech.merge_short_blocks(speech.paginate(_turn_blocks(spark, sf_dir), 8)).select("doc_id", "part_idx", "block_idx", "type", "content")


# --- the timed script ---------------------------------------------------------------------------------------------------------------------
_SENTENCE = " стоит в этой строке, и за ним идёт продолжение; на этом всё."


def _script_blocks(spark, sf_dir) -> DataFrame:
    from ..functions import numerals as N

    turn = F.col("turn")
    kind = F.get(F.array(*map(F.lit, ("text", "emphasis", "footnote", "pause"))), (turn % 4).cast("int"))
    said = F.concat(F.lit("Число "), N.cardinal(F.col("conv_id") * 1000 + turn), F.lit(_SENTENCE))
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chapter_idx"), turn.cast("int").alias("block_idx"), kind.alias("type"))
    rows = rows.withColumn("content", F.when(F.col("type") != "pause", F.lit(1)).cast("string"))
    text = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.cast("int").alias("block_idx"), said.alias("said"))
    rows = rows.drop("content").join(text, ["doc_id", "block_idx"]).withColumn("content", F.when(F.col("type") != "pause", F.col("said")))
    return rows.select("doc_id", "chapter_idx", "block_idx", "type", "content", F.when(F.col("type") == "footnote", F.concat(F.lit("["), F.col("block_idx").cast("string"), F.lit("]"))).alias("title"), F.when(F.col("type") == "pause", F.lit(0.7)).alias("duration"))


def _row(kind: str, voice: str | None, text: str, pause: float) -> str:
    lang = "'ru'" if kind == "speech" else "NULL"
    return f"{{'kind': '{kind}', 'lang': {lang}::VARCHAR, 'voice': {quote(voice) if voice else 'NULL'}::VARCHAR, 'text': ({text})::VARCHAR, 'pause_after': {pause}::DOUBLE}}"


def _script_sql(s: Settings) -> str:
    main, service, emphasis = (s.voice(x) for x in ("ru", "service", "emphasis"))
    rest = lambda seconds: _row("pause", None, "NULL", seconds)
    text = f"[{_row('speech', main, 'said', 0.0)}, {rest(s.pause_between_paragraphs)}]"
    strong = f"[{_row('speech', emphasis, 'said', 0.0)}, {rest(s.pause_between_paragraphs)}]"
    note = f"[{rest(s.footnote_pause_before)}, {_row('speech', service, quote(s.footnote_prefix + ' [') + ' || turn || ' + quote(']'), 0.0)}, {rest(script.BETWEEN)}, {_row('speech', main, 'said', 0.0)}, {rest(script.BETWEEN)}, {_row('speech', service, quote(s.footnote_suffix), 0.0)}, {rest(s.footnote_pause_after)}, {rest(script.BETWEEN)}]"
    # a text before a footnote does not occur; sentences are whole, so nothing is joined
    return f"""WITH c AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, 'Число ' || {cardinal('(conv_id * 1000 + turn)')} || {quote(_SENTENCE)} AS said FROM conversations),
e AS (SELECT doc_id, (k // 100)::INT AS part_idx, (k % 100)::INT AS block_idx, CASE turn % 4 WHEN 0 THEN {text} WHEN 1 THEN {strong} WHEN 2 THEN {note} ELSE [{rest(0.7)}] END AS rows FROM c),
i AS (SELECT *, unnest(range(len(rows))) AS i FROM e)
SELECT doc_id, part_idx, block_idx, i::INT AS seg_idx, 0 AS chunk_idx, rows[i + 1].kind AS kind, rows[i + 1].lang AS lang, rows[i + 1].voice AS voice, rows[i + 1].text AS text, 0.0::DOUBLE AS pause_before, rows[i + 1].pause_after AS pause_after FROM i"""


@query(_script_sql(DEFAULTS))
def timed_segments(spark, sf_dir):
    return script.script(speech.paginate(_script_blocks(spark, sf_dir), DEFAULTS.blocks_per_part))


@query()
def book_scripts(spark, sf_dir):
    files = book_files(spark, sf_dir)
    return script.book_script(books.book_blocks(files), books.book_notes(files))


# --- chunks -------------------------------------------------------------------------------------------------------------------------------
_BEST = """list_aggregate(list_concat([-3009100],
list_transform(list_filter(range(452, 901), lambda i: c[i] IN ('.', '!', '?', '…') AND (i = 900 OR (c[i + 1] = ' ' AND (i = 899 OR (upper(c[i + 2]) = c[i + 2] AND lower(c[i + 2]) <> c[i + 2]) OR regexp_matches(c[i + 2], '\\p{Nd}') OR c[i + 2] IN ('«', '"', '''', '('))))), lambda i: i + CASE WHEN i < 900 THEN 1 ELSE 0 END),
list_transform(list_filter(range(452, 901), lambda i: c[i] IN (':', ';')), lambda i: -10000 + i + CASE WHEN i < 900 AND c[i + 1] = ' ' THEN 1 ELSE 0 END),
list_transform(list_filter(range(452, 901), lambda i: c[i] = ','), lambda i: -20000 + i + CASE WHEN i < 900 AND c[i + 1] = ' ' THEN 1 ELSE 0 END),
list_transform(list_filter(range(452, 901), lambda i: c[i] = ' '), lambda i: -30000 + i)), 'max')"""


@query(
    f"""WITH RECURSIVE w AS (SELECT doc_id, 0 AS k, text AS rest, NULL::VARCHAR AS chunk, length(text) > 900 AS was_cut FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, k + 1, CASE WHEN length(rest) > 900 THEN {strip('substr(rest, spot + 1)')} END, CASE WHEN length(rest) > 900 THEN {strip('left(rest, spot)')} ELSE rest END, was_cut
FROM (SELECT *, CASE WHEN length(rest) > 900 THEN ((b % 10000) + 10000) % 10000 ELSE 0 END::INT AS spot FROM (SELECT *, CASE WHEN length(rest) > 900 THEN {_BEST} END AS b FROM (SELECT *, string_split(left(rest, 900), '') AS c FROM w WHERE rest IS NOT NULL))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_idx, chunk FROM w WHERE chunk IS NOT NULL AND (CASE WHEN was_cut THEN length(chunk) >= 2 ELSE regexp_matches(chunk, '\\S') END)"""
)
def chunk_plan(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(speech.chunks(F.col("text"))).alias("chunk_idx", "chunk"))
