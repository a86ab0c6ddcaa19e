"""Command lines: ``python -m spoken normalize BOOK`` and ``python -m spoken script BOOK``, over a file or a folder of FictionBook files.

What they do is in ``plans`` and ``sources``; here options become arguments. Results are files: normalized books beside a run log, reports,
and scripts as Parquet.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.steps import OFF
from .plans import pipeline, reports, script
from .sources import books, dictionaries
from .sources.fb2 import text_nodes
from .sources.settings import MODEL_LANGUAGE, MODEL_STRESS, Settings, clamped, load_settings

# --- fixed values: what the steps are called; voices of the Russian models of one language --------------------------------------------
STEP_NAMES = {"1": "typography", "2": "URLs and e-mail", "3": "regular expressions", "4": "abbreviations (no effect)", "5": "section references", "6": "digit groups", "7": "ranges", "8": "dates", "8.5": "decimals with a hyphen", "9": "compound numerals", "10": "time", "11": "fractions", "12": "percent", "13": "multipliers", "14": "units", "15": "ordinals with suffixes", "16": "acronyms", "17": "rulers", "18": "letters with digits", "19": "case agreement (no effect)", "20": "restoring of markers", "21": "symbols", "22": "decimals", "23": "currency", "24": "negative numbers", "25": "numbers", "26": "transliteration (no effect)", "27": "Greek", "28": "language tags", "29": "Latin diacritics"}
SPEAKERS = ("aidar", "baya", "kseniya", "xenia", "eugene")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spoken")
    verbs = p.add_subparsers(dest="verb", required=True)
    n = verbs.add_parser("normalize", help="normalize the texts of books")
    n.add_argument("input", nargs="?")
    n.add_argument("-o", "--output", help="folder of the normalized books")
    n.add_argument("--force", action="store_true", help="also books that the run log has")
    n.add_argument("--dry-run", action="store_true", help="show the first changes only")
    n.add_argument("--find-acro", action="store_true", help="write acronyms that no dictionary has")
    n.add_argument("--list-steps", action="store_true")
    n.add_argument("--no-logs", action="store_true")
    n.add_argument("--log-dir", default="logs")
    for name in ("ru", "en", "patterns", "rulers"):
        n.add_argument(f"--{name}-dict", help="dictionary file")
    for step in STEP_NAMES:
        n.add_argument(f"--{step}-off", dest="off", action="append_const", const=step, help=argparse.SUPPRESS)
    s = verbs.add_parser("script", help="plan the speech of books")
    s.add_argument("input", nargs="?")
    s.add_argument("-o", "--output", help="folder of the script (Parquet)")
    s.add_argument("--config", help="settings, YAML or JSON")
    for name, kind in (("ru-model", str), ("en-model", str), ("ru-speaker", str), ("en-speaker", str), ("service-speaker", str), ("sample-rate", int), ("speed", float)):
        s.add_argument(f"--{name}", type=kind)
    s.add_argument("--loudness", type=float, dest="loudness_target")
    s.add_argument("--no-calibrate", action="store_true")
    s.add_argument("--skip-footnotes", action="store_true", default=None)
    s.add_argument("--dry-run", action="store_true", help="show the profile of the books only")
    s.add_argument("--list-models", action="store_true")
    s.add_argument("--list-speakers", action="store_true")
    return p


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fb2").load(path).select("path", "content")


def normalize_books(spark: SparkSession, source: str, output: str, log_dir: str, disabled: set[str], words: dictionaries.Dictionaries, force: bool = False, logs: bool = True) -> list[str]:
    """Normalizes the books that the run log does not have as they are, writes them under their names, and returns these."""
    files = _files(spark, source)
    disabled, log_path = frozenset(disabled), f"{log_dir}/run_log"
    seen = Path(log_path).exists() and not force
    if seen:
        log = spark.read.parquet(log_path)
        made = spark.read.format("binaryFile").load(output) if Path(output).exists() else files.limit(0)
        done = made.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        outputs = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).join(done, "name").select("path", "content")
        files = pipeline.pending(files, outputs, log, disabled, words)
    files = files.cache()
    if not files.limit(1).count():
        files.unpersist()
        return []
    nodes = text_nodes(files).cache()
    after = pipeline.normalize(nodes, disabled=disabled, dictionaries=words)
    finished = books.normalized_books(files, after).cache()
    both = nodes.select("doc_id", "node_idx", "text").join(after.select("doc_id", "node_idx", F.col("text").alias("new")), ["doc_id", "node_idx"])
    counts = both.groupBy(F.col("doc_id").alias("path")).agg(F.count_if(F.col("text") != F.col("new")).alias("changed"), F.count("*").alias("total"))
    done = pipeline.run_log(files, finished.join(counts, "path", "left").fillna(0), disabled, words)
    Path(output).mkdir(parents=True, exist_ok=True)
    names = []
    for row in finished.toLocalIterator():  # a book at a time
        name = row["path"].rpartition("/")[2]
        (Path(output) / name).write_bytes(bytes(row["content"]))
        names.append(name)
    done.write.mode("append").parquet(log_path)
    if logs:
        keys = ("doc_id", "node_idx")
        log = reports.replacement_log(nodes, keys, disabled=disabled, dictionaries=words).cache()
        reports.write_reports(log, reports.run_summary(nodes, disabled=disabled, dictionaries=words), reports.english_phrases(after, keys).orderBy(*keys, "pos"), log_dir)
        log.unpersist()
    for df in (finished, nodes, files):  # what is cached would stand in for files that change later
        df.unpersist()
    return sorted(names)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = lambda: spark or SparkSession.builder.appName("spoken").getOrCreate()
    if a.verb == "normalize":
        if a.list_steps:
            print("\n".join(f"{k:>4}  {v}" for k, v in STEP_NAMES.items()))
            return 0
        if not a.input:
            parser().error("a book or a folder is needed")
        disabled = set(OFF) | set(a.off or ())
        words = dictionaries.load(session(), a.ru_dict, a.en_dict, a.patterns_dict, a.rulers_dict)
        if a.dry_run:
            found = reports.preview(text_nodes(_files(session(), a.input)), ("doc_id", "node_idx"), disabled=disabled, dictionaries=words).collect()
            for i, r in enumerate(found, 1):
                print(f"[{i}] {r['doc_id']}\n  - {r['before']}\n  + {r['after']}")
            print(f"{len(found)} changes")
        elif a.find_acro:
            known = session().createDataFrame([("ru", k) for k in words.ru] + [("en", k) for k in words.en], "lang string, key string")
            reports.write_acronyms(pipeline.unknown_acronyms(text_nodes(_files(session(), a.input)), known), a.log_dir)
        else:
            names = normalize_books(session(), a.input, a.output or "normalized", a.log_dir, disabled, words, a.force, not a.no_logs)
            print(f"{len(names)} books normalized")
        return 0
    if a.list_models:
        print("\n".join(f"{k}  ru, {v} stress" for k, v in MODEL_STRESS.items()) + "\n" + "\n".join(f"{k}  {v}" for k, v in MODEL_LANGUAGE.items()))
        return 0
    given = {k: getattr(a, k) for k in ("ru_model", "en_model", "ru_speaker", "en_speaker", "service_speaker", "sample_rate", "speed", "loudness_target", "skip_footnotes")}
    try:
        settings = clamped(load_settings(a.config, **given))
    except ValueError as error:
        print(error)
        return 1
    if a.no_calibrate:
        settings = Settings(**(asdict(settings) | {"loudness_target": None}))
    for problem in settings.problems():
        print("setting:", problem)
    if a.list_speakers:
        print("\n".join(sorted({*SPEAKERS, settings.voice("ru"), settings.voice(settings.foreign)})))
        return 0
    if not a.input:
        parser().error("a book or a folder is needed")
    files = _files(session(), a.input)
    blocks = books.book_blocks(files, settings)
    if a.dry_run:
        for r in script.profile(blocks, settings).orderBy("doc_id").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        script.book_script(blocks, books.book_notes(files), settings).write.mode("overwrite").parquet(a.output or "script")
    return 0
