"""The speech script of books: chapters, parts, joined blocks, timed segments and chunks, each a row in reading order.

    blocks -> notes joined -> chapter pauses -> parts -> short blocks joined -> forced commas -> segments -> chunks

Only the numbering of a book's blocks shuffles by book; the rest works within parts, which are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import speech
from ..sources.settings import DEFAULTS, Settings

#: Seconds of silence around the parts of a footnote, and of a text that has nothing to say.
BETWEEN, NOTHING = 0.2, 0.1
SCRIPT = ("doc_id", "part_idx", "block_idx", "seg_idx", "chunk_idx", "kind", "lang", "voice", "text", "pause_before", "pause_after")


def with_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Blocks whose footnotes have their note's text as content. References without a note go; of repeated notes the last counts. Only
    references take part in the join."""
    last = notes.groupBy("doc_id", "note_id").agg(F.max_by("note_text", "pos").alias("note_text"))
    refs = blocks.filter("type = 'footnote'").drop("content").join(last, ["doc_id", "note_id"]).withColumnRenamed("note_text", "content")
    return blocks.filter("type <> 'footnote'").unionByName(refs.select(*blocks.columns))


def with_chapter_pauses(blocks: DataFrame, seconds: float = DEFAULTS.pause_between_chapters) -> DataFrame:
    """Blocks with a pause after each chapter."""
    ends = blocks.groupBy("doc_id", "chapter_idx").agg((F.max("block_idx") + 1).cast("int").alias("block_idx"))
    pause = ends.withColumns({"type": F.lit("pause"), "duration": F.lit(float(seconds))})
    return blocks.unionByName(pause, allowMissingColumns=True)


def _segment(use: str, text: Column | None = None, pause: Column | float = 0.0) -> Column:
    pause = pause if isinstance(pause, Column) else F.lit(float(pause))
    return F.struct(F.lit(use).alias("use"), (F.lit(None) if text is None else text).cast("string").alias("text"), pause.cast("double").alias("pause"))


def segments(s: Settings = DEFAULTS) -> Column:
    """array<struct<use, text, pause>> of a block with the columns type, content, title and duration: what is said by which use of a
    voice (main, service, emphasis), and silences."""
    content, rest = F.col("content"), _segment("pause", pause=s.pause_between_paragraphs)
    none = F.array().cast("array<struct<use:string,text:string,pause:double>>")
    told = F.coalesce(F.trim(content), F.lit("")) != ""
    emphasis = [_segment("main", content)] if s.emphasis_as_text else [
        *([_segment("pause", pause=s.emphasis_pause_before)] if s.emphasis_pause_before > 0 else []), _segment("emphasis", content),
        *([_segment("pause", pause=s.emphasis_pause_after)] if s.emphasis_pause_after > 0 else []), rest,
    ]
    title = F.coalesce(F.col("title"), F.lit(""))
    called = F.when(title != "", F.concat(F.lit(s.footnote_prefix + " "), title)).otherwise(F.lit(s.footnote_prefix))
    between = _segment("pause", pause=BETWEEN)
    said = F.when(told, F.array(_segment("main", content), between)).otherwise(none)
    note = F.concat(F.array(_segment("pause", pause=s.footnote_pause_before), _segment("service", called), between), said, F.array(_segment("service", F.lit(s.footnote_suffix)), _segment("pause", pause=s.footnote_pause_after), between))
    kind = F.col("type")
    out = F.when((kind == "text") & told, F.array(_segment("main", content), rest)).when((kind == "emphasis") & told, F.array(*emphasis))
    return out.when(kind == "footnote", none if s.skip_footnotes else note).when(kind == "pause", F.array(_segment("pause", pause=F.coalesce("duration", F.lit(0.3))))).otherwise(none)


def _pieces(text: Column, s: Settings) -> Column:
    """array<struct<lang, text, pause>> of a main text; the pause, where forced, is that after its last piece."""
    own = speech.split_by_language(text, s.foreign)
    if not s.force_punctuation or s.ssml_enabled:
        return F.transform(own, lambda x: F.struct(x["lang"], x["text"], F.lit(None).cast("double").alias("pause")))

    def cut(row: Column) -> Column:
        langs = speech.split_by_language(row["text"], s.foreign)
        return F.transform(langs, lambda x, i: F.struct(x["lang"], x["text"], F.when(i == F.size(langs) - 1, row["pause"]).otherwise(0.0).alias("pause")))

    return F.flatten(F.transform(speech.forced_pauses(text, s.pauses), cut))


def script(parted: DataFrame, s: Settings = DEFAULTS, speakers: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, part_idx, block_idx, seg_idx, chunk_idx, kind, lang, voice, text, pause_before, pause_after) of blocks with part_idx.

    Rows are numbered from 0: blocks through a part, segments through a block, chunks through a segment. ``kind`` is speech or pause; a
    pause has no text. A main text is cut by language, cleaned and cut into chunks; Latin letters left in Russian ones are written in
    Cyrillic. The pause after a segment's last chunk is left out if it is under half a second, since the paragraph's follows; forced
    pauses stay. A text without anything to say is a short silence.
    """
    joined = speech.merge_short_blocks(parted)
    if s.footnote_force_comma:
        joined = speech.forced_comma(joined)
    in_part = Window.partitionBy("doc_id", "part_idx").orderBy("chapter_idx", "block_idx")
    rows = joined.withColumn("block_idx", (F.row_number().over(in_part) - 1).cast("int"))
    rows = rows.select("doc_id", "part_idx", "block_idx", F.posexplode(segments(s)).alias("seg_idx", "g")).select("doc_id", "part_idx", "block_idx", "seg_idx", "g.*")
    main = F.col("use") == "main"
    text = F.regexp_replace("text", "[()]", ", ")
    whole = F.array(F.struct(F.lit("ru").alias("lang"), F.col("text"), F.lit(None).cast("double").alias("pause")))
    rows = rows.withColumnRenamed("pause", "silence").withColumn("pieces", F.when(main, _pieces(text, s)).otherwise(whole))
    rows = rows.select("doc_id", "part_idx", "block_idx", "seg_idx", "use", "silence", F.posexplode_outer("pieces").alias("piece_idx", "x"))
    rows = rows.select("doc_id", "part_idx", "block_idx", "seg_idx", "use", "silence", "piece_idx", F.col("x.lang").alias("lang"), F.col("x.text").alias("text"), F.col("x.pause").alias("forced"))
    rows = rows.withColumn("text", F.when(main, speech.clean_for_tts(F.col("text"))).otherwise(F.col("text")))
    said = F.when(main & (F.length("text") < 2), None).otherwise(F.col("text"))
    if s.ssml_enabled:
        marked = F.when(main & (F.col("lang") == "ru"), speech.ssml(said, s.pauses, wrap=False)).otherwise(said)
        rows = rows.withColumn("text", marked).withColumn("chunks", F.when(F.col("lang") == "ru", speech.ssml_chunks(F.col("text"), s.max_chunk_length)).otherwise(speech.chunks(F.col("text"), s.max_chunk_length)))
    else:
        rows = rows.withColumn("chunks", F.when(main, speech.chunks(said, s.max_chunk_length)).otherwise(F.filter(F.array("text"), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "part_idx", "block_idx", "seg_idx", "use", "silence", "piece_idx", "lang", "forced", F.size("chunks").alias("n"), F.posexplode_outer("chunks").alias("at", "text"))

    order = Window.partitionBy("doc_id", "part_idx", "block_idx", "seg_idx").orderBy("piece_idx", "at")
    after = F.lead(F.lit(1)).over(order)
    own = F.col("lang") == "ru"
    pause = speech.pause_after(F.col("text"), s.pauses)
    natural = F.when(after.isNull() & (pause < 0.5), 0.0).otherwise(pause)
    if s.force_punctuation and not s.ssml_enabled:
        natural = F.when(F.col("at") == F.col("n") - 1, F.col("forced")).otherwise(0.0)
    if s.ssml_enabled:
        natural = F.lit(0.0)
    spoken = F.when(own & main & F.col("text").rlike("[A-Za-z]") & F.lit(not s.ssml_enabled), speech.transliterate(F.col("text"))).otherwise(F.col("text"))
    if s.ssml_enabled:
        spoken = F.when(own & main, F.concat(F.lit("<speak>"), F.col("text"), F.lit("</speak>"))).otherwise(spoken)
        spoken = F.when(F.col("use") == "emphasis", speech.emphasis_ssml(F.col("text"), s.emphasis_speed, s.emphasis_pitch)).otherwise(spoken)
    # a segment of which nothing is left to say is one row of silence; other pieces without chunks are none
    rows = rows.withColumn("some", F.max(F.col("text").isNotNull()).over(Window.partitionBy("doc_id", "part_idx", "block_idx", "seg_idx")))
    rows = rows.filter("text is not null or (not some and coalesce(piece_idx, 0) = 0)")
    voice = F.when(F.col("use").isin("service", "emphasis"), F.when(F.col("use") == "service", s.voice("service", speakers)).otherwise(s.voice("emphasis", speakers))).when(own, s.voice("ru", speakers)).otherwise(s.voice(s.foreign, speakers))
    speaks = F.col("text").isNotNull()
    return rows.select(
        "doc_id", "part_idx", "block_idx", "seg_idx", (F.row_number().over(order) - 1).cast("int").alias("chunk_idx"),
        F.when(speaks, "speech").otherwise("pause").alias("kind"), F.when(speaks, F.col("lang")).alias("lang"), F.when(speaks, voice).alias("voice"), F.when(speaks, spoken).alias("text"),
        F.when(speaks & main & ~own, float(s.en_pause_before)).otherwise(0.0).alias("pause_before"),
        F.when(~speaks, F.when(F.col("use") == "pause", F.col("silence")).otherwise(NOTHING)).when(main, natural + F.when(~own, float(s.en_pause_after)).otherwise(0.0)).otherwise(0.0).alias("pause_after"),
    ).select(*SCRIPT)


def book_script(blocks: DataFrame, notes: DataFrame, s: Settings = DEFAULTS, speakers: dict[str, list[str]] | None = None) -> DataFrame:
    """``script`` of books, from their blocks and notes."""
    every = with_chapter_pauses(with_notes(blocks, notes), s.pause_between_chapters)
    return script(speech.paginate(every, s.blocks_per_part), s, speakers)


def profile(blocks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row a book: chapters, blocks, text blocks, footnotes, characters of texts, those of texts with Latin letters and their share in
    percent, the share of the others, parts without and with the pauses after chapters."""
    text = F.col("type") == "text"
    chars = F.coalesce(F.sum(F.when(text, F.length("content"))), F.lit(0))
    latin = F.coalesce(F.sum(F.when(text & speech.has_latin(F.col("content")), F.length("content"))), F.lit(0))
    out = blocks.groupBy("doc_id").agg(
        F.countDistinct("chapter_idx").alias("chapters"), F.count("*").alias("blocks"), F.count_if(text).alias("text_blocks"), F.count_if(F.col("type") == "footnote").alias("footnotes"), chars.alias("chars"), latin.alias("latin_chars"),
    )
    share = lambda x: F.round(100.0 * x / F.greatest(F.lit(1), F.col("chars")), 1)
    parts = lambda n: F.ceil(n / s.blocks_per_part)
    return out.withColumns({"latin_pct": share(F.col("latin_chars")), "cyrillic_pct": share(F.col("chars") - F.col("latin_chars")), "parts": parts(F.col("blocks")), "parts_with_pauses": parts(F.col("blocks") + F.col("chapters"))})
