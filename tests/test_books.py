import json

import pytest
from pyspark.sql import functions as F

from spoken.plans import pipeline, reports, script
from spoken.sources import books
from spoken.sources.fb2 import text_nodes
from spoken.sources.settings import DEFAULTS, Settings, clamped, load_settings

BOOK = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink">
 <description><title-info>
  <author><first-name>Анна</first-name><last-name>Рощина</last-name></author>
  <book-title>Дом у реки</book-title>
  <annotation><p>Повесть в 2 частях.</p></annotation>
 </title-info></description>
 <body>
  <section><title><p>Глава 1</p></title>
   <p>В 12:05 пришёл поезд<a type="note" l:href="#n1">[1]</a> из <emphasis>Твери</emphasis>, №7.</p>
   <subtitle>Вечер</subtitle><p>Осталось 5%.</p><empty-line/>
   <p>Ссылка<a type="note" l:href="#missing">[2]</a> пуста.</p>
  </section>
 </body>
 <body name="notes"><section id="n1"><title><p>1</p></title><p>Старый поезд.</p></section></body>
</FictionBook>"""


def files(spark, *contents):
    return spark.createDataFrame([(f"{i}.fb2", bytearray(c.encode()) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")


def wrap(body, notes=""):
    return f'<FictionBook xmlns="{books.NS}" xmlns:l="{books.XLINK}">{body}{notes}</FictionBook>'


def test_blocks_of_a_book(spark):
    rows = books.book_blocks(files(spark, BOOK)).orderBy("chapter_idx", "block_idx").collect()
    got = [(r["chapter_idx"], r["type"], r["content"] or r["note_id"] or r["duration"]) for r in rows]
    assert got == [
        (0, "text", "Анна Рощина."), (1, "text", "Дом у реки."), (2, "text", "Аннотация"), (2, "text", "Повесть в 2 частях."), (2, "text", "Конец аннотации"),
        (3, "text", "Глава 1"), (3, "pause", 0.4), (3, "text", "В 12:05 пришёл поезд"), (3, "footnote", "n1"), (3, "text", " из "), (3, "text", "Твери"), (3, "text", ", №7."),
        (3, "pause", 0.8), (3, "text", "Вечер"), (3, "pause", 0.4), (3, "text", "Осталось 5%."), (3, "pause", 0.5), (3, "text", "Ссылка"), (3, "text", " пуста."),
    ]
    assert [tuple(r)[1:] for r in books.book_notes(files(spark, BOOK)).collect()] == [("n1", 0, "Старый поезд.")]


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        ("<body><p>без разделов</p><epigraph><p>раз</p><p>два</p></epigraph></body>", [[("text", "без разделов"), ("text", "раз два")]]),
        ("<body><emphasis> громко </emphasis><section><p>а <tts_en>b <b>c</b></tts_en> д</p></section></body>", [[("emphasis", "громко")], [("text", "а "), ("text", "<tts_en>b c</tts_en>"), ("text", " д")]]),
        ("<body><section><section><title><p>т</p></title><p>а</p></section><section><title><p>у</p></title></section></section></body>", [[("text", "т"), ("pause", 0.4), ("text", "а"), ("pause", 0.8), ("text", "у"), ("pause", 0.4)]]),
        ("<body><section><empty-line/><image/><p><a l:href='http://x'>ссылка <b>и</b></a></p></section></body>", [[("text", "ссылка и")]]),
        ("<body><section><subtitle> </subtitle><p>а</p><subtitle/></section></body>", [[("text", "а"), ("pause", 0.8)]]),
        ("<body/><body name='notes'><section id='n'><p>сноска</p></section></body>", []),
    ],
)
def test_elements(body, blocks):
    got = [[(b["type"], b.get("content") or b.get("duration")) for b in c] for c in books.chapters_of(wrap(body).encode())]
    assert got == blocks


def test_odd_files(spark):
    odd = files(spark, None, "", "no xml", wrap(""), wrap("<body>" + "<section>" * 3000 + "</section>" * 3000 + "</body>"))
    assert books.book_blocks(odd).count() == 0 and books.book_notes(odd).count() == 0
    assert books.book_blocks(odd.limit(0)).count() == 0


def test_repeated_notes_and_missing_ones(spark):
    note = '<body name="notes"><section id="n"><p>первая</p></section><section id="n"><p>вторая</p></section><section><p>без</p></section><section id="m"><title><p>пуста</p></title></section></body>'
    book = wrap('<body><section><p>а<a type="note" l:href="#n">1</a><a type="note" l:href="m">2</a></p></section></body>', note)
    blocks = script.with_notes(books.book_blocks(files(spark, book)), books.book_notes(files(spark, book))).orderBy("block_idx").collect()
    assert [(r["type"], r["content"], r["title"]) for r in blocks] == [("text", "а", None), ("footnote", "вторая", "1")]


def test_script_of_a_book(spark):
    rows = script.book_script(books.book_blocks(files(spark, BOOK)), books.book_notes(files(spark, BOOK))).orderBy("part_idx", "block_idx", "seg_idx", "chunk_idx").collect()
    said = [(r["kind"], r["text"] if r["kind"] == "speech" else r["pause_after"]) for r in rows]
    assert said[:4] == [("speech", "Анна Рощина."), ("pause", 0.2), ("pause", 1.5), ("speech", "Дом у реки.")]
    at = said.index(("speech", "В 12:05 пришёл поезд,"))
    assert said[at : at + 10] == [("speech", "В 12:05 пришёл поезд,"), ("pause", 0.2), ("pause", 0.3), ("speech", "Сноска [1]"), ("pause", 0.2), ("speech", "Старый поезд."), ("pause", 0.2), ("speech", "Конец сноски"), ("pause", 0.3), ("pause", 0.2)]
    assert all(r["voice"] == "ru_dmitriy" and r["lang"] == "ru" for r in rows if r["kind"] == "speech")
    silent = script.book_script(books.book_blocks(files(spark, BOOK)), books.book_notes(files(spark, BOOK)), Settings(skip_footnotes=True, footnote_force_comma=False))
    assert silent.filter("text like 'Сноска%'").count() == 0 and silent.filter("text = 'В 12:05 пришёл поезд'").count() == 1


def _script(spark, blocks, **options):
    rows = [("d", 0, i, *b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id string, chapter_idx int, block_idx int, type string, content string, title string, duration double").withColumn("part_idx", F.lit(0))
    return [tuple(r)[3:] for r in script.script(df, Settings(**options)).orderBy("block_idx", "seg_idx", "chunk_idx").collect()]


def test_script_of_texts(spark):
    text = "да (нет) <tts_en>a big house</tts_en> и WWW."
    rows = _script(spark, [("text", text)], en_pause_before=0.1, en_pause_after=0.1)
    assert rows == [
        (0, 0, "speech", "ru", "ru_dmitriy", "да , нет,", 0.0, 0.05), (0, 1, "speech", "en", "en_0", "a big house", 0.1, 0.1), (0, 2, "speech", "ru", "ru_dmitriy", "и дабл ю дабл ю дабл ю.", 0.0, 0.0), (1, 0, "pause", None, None, None, 0.0, 0.2),
    ]
    assert _script(spark, [("text", "<<>>"), ("text", " "), ("pause", None)]) == [(0, 0, "pause", None, None, None, 0.0, 0.1), (1, 0, "pause", None, None, None, 0.0, 0.2), (0, 0, "pause", None, None, None, 0.0, 0.3)]
    forced = _script(spark, [("text", "раз, два; три.")], force_punctuation=True)
    assert [(r[5], r[7]) for r in forced] == [("раз,", 0.05), ("два;", 0.1), ("три.", 0.05), (None, 0.2)]
    marked = _script(spark, [("text", "раз, два; три."), ("emphasis", "громко")], ssml_enabled=True)
    assert marked[0][5] == '<speak>раз,<break time="50ms"/> два;<break time="100ms"/> три.</speak>' and "prosody" in marked[2][5]
    assert [r[2] for r in _script(spark, [("emphasis", "громко")], emphasis_as_text=True)] == ["speech"]
    long = _script(spark, [("text", "Это предложение стоит здесь не один раз. " * 60)])
    assert [r[1] for r in long[:-1]] == list(range(len(long) - 1)) and all(r[7] == 0.05 for r in long[:-2]) and long[-2][7] == 0.0


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"speed": 9, "blocks_per_part": 0, "other": 1}))
    (tmp_path / "c.yml").write_text("# file\nru_model: v5_5_ru  # model\nspeed: 0.1\nemphasis_as_text: true\nen_speaker: 'en_7'\nlist:\n  - 1\n")
    own = load_settings(str(tmp_path / "c.json"), loudness_target=3.0, speed=None)
    assert own.problems() == ["speed must be at most 4", "loudness_target must not be above 0", "blocks_per_part must be at least 1"] and clamped(own).speed == 4
    own = load_settings(str(tmp_path / "c.yml"))
    assert (own.ru_model, own.stress, own.emphasis_as_text, own.en_speaker, clamped(own).speed, own.voice("ru"), own.voice("en")) == ("v5_5_ru", "auto", True, "en_7", 0.25, "kseniya", "en_7")
    (tmp_path / "bad.json").write_text("{")
    assert load_settings(str(tmp_path / "bad.json")) == DEFAULTS == load_settings("nowhere.json")
    assert DEFAULTS.voice("ru", {"ru": ["a", "ru_b"]}) == "ru_b" and Settings(service_speaker="s").voice("service") == "s" and DEFAULTS.voice("de", {"de": ["x"]}) == "x"
    with pytest.raises(ValueError):
        clamped(Settings(speed=0))


def test_normalized_books(spark):
    own = files(spark, BOOK, "no xml")
    nodes = text_nodes(own)
    changed = nodes.withColumn("text", F.when(F.col("text").contains("5%"), "Осталось <tts_en>five</tts_en> & всё.").otherwise(F.upper("text")))
    out = {r["path"]: bytes(r["content"]).decode() for r in books.normalized_books(own, changed).collect()}
    assert out["1.fb2"] == "no xml" and "Осталось <tts_en>five</tts_en> &amp; всё." in out["0.fb2"] and ", №7." in out["0.fb2"] and " ИЗ <emphasis>ТВЕРИ</emphasis>" in out["0.fb2"]
    again = text_nodes(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in out.items()], "path string, content binary"))
    assert again.filter("text = ' ИЗ '").count() == 1


def test_reports_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Осталось «5%» и 3 км"), (2, "Ничего"), (3, None), (4, "да <tts_en>x</tts_en>")], "doc_id long, text string")
    log, run = reports.replacement_log(docs).cache(), reports.run_summary(docs).cache()
    reports.write_reports(log, run, reports.english_phrases(docs), str(tmp_path))
    read = lambda name: spark.read.text(f"{tmp_path}/{name}").collect()
    found = json.loads(read("normalization_summary")[0][0])
    assert found["total_processed"] == 3 and found["total_changed"] == 1 and found["steps"]["1"]["top_replacements"] == [{"pattern": "«5%» → \"5%\"", "count": 1}]
    table = spark.read.option("header", "true").csv(f"{tmp_path}/normalization_log").collect()
    assert [r["step"] for r in table] == ["1", "12", "14a", "14a"] and table[0]["context"] == "Осталось «5%» и 3" and all(line[0].startswith('"') for line in read("normalization_log"))
    assert read("normalization_report")[1][0] == "Changed: 1 (33.33%)" and read("tts_en_phrases")[0][0] == "x"
    reports.write_acronyms(pipeline.unknown_acronyms(spark.createDataFrame([("ЯБ и АБ, USA",)], "text string"), spark.createDataFrame([], "lang string, key string")), str(tmp_path))
    assert [r[0] for r in read("acro_ru_new")] == ["АБ", "ЯБ"] and [r[0] for r in read("acro_en_new")] == ["USA"]


def test_runs_are_remembered(spark):
    sources = spark.createDataFrame([("a", "5%"), ("b", "6%")], "path string, content string")
    outputs = sources.withColumn("content", F.concat("content", F.lit(" out")))
    log = pipeline.run_log(sources, outputs.withColumns({"changed": F.lit(1), "total": F.lit(2)}))
    left = lambda **o: sorted(r["path"] for r in pipeline.pending(sources, o.pop("outputs", outputs), log, **o).collect())
    assert left() == [] and left(disabled={"12"}) == ["a", "b"]
    assert left(outputs=outputs.filter("path = 'a'")) == ["b"] and left(outputs=outputs.withColumn("content", F.lit("x"))) == ["a", "b"]
