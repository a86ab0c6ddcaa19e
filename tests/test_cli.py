import json

import pytest

from spoken import cli
from tests.test_books import BOOK


def run(spark, capsys, *argv):
    code = cli.main([str(a) for a in argv], spark)
    return code, capsys.readouterr().out


def test_normalize(spark, capsys, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fb2").write_text(BOOK, encoding="utf-8")
    where = (tmp_path / "in", "-o", tmp_path / "out", "--log-dir", tmp_path / "logs", "--no-logs")
    assert run(spark, capsys, "normalize", *where) == (0, "1 books normalized\n")
    text = (tmp_path / "out" / "a.fb2").read_text(encoding="utf-8")
    assert "двена́дцать часо́в пя́ть мину́т" in text and " из <emphasis>" in text
    assert run(spark, capsys, "normalize", *where) == (0, "0 books normalized\n")
    (tmp_path / "in" / "a.fb2").write_text(BOOK.replace("5%", "6%"), encoding="utf-8")
    assert run(spark, capsys, "normalize", *where, "--12-off") == (0, "1 books normalized\n")
    assert "ше́сть%" in (tmp_path / "out" / "a.fb2").read_text(encoding="utf-8")
    assert not (tmp_path / "logs" / "normalization_report").exists() and spark.read.parquet(str(tmp_path / "logs" / "run_log")).count() == 2


def test_inspection(spark, capsys, tmp_path):
    (tmp_path / "a.fb2").write_text(BOOK.replace("Вечер", "Вечер в ССР и USA"), encoding="utf-8")
    code, out = run(spark, capsys, "normalize", tmp_path, "--dry-run")
    assert code == 0 and "- В 12:05 пришёл поезд" in out and out.rstrip().endswith("changes")
    run(spark, capsys, "normalize", tmp_path, "--find-acro", "--log-dir", tmp_path / "found")
    assert [r[0] for r in spark.read.text(str(tmp_path / "found" / "acro_ru_new")).collect()] == ["ССР"]
    assert "  8.5  " in " " + run(spark, capsys, "normalize", "--list-steps")[1].replace(" 8.5", "  8.5")
    with pytest.raises(SystemExit):
        cli.main(["normalize"], spark)


def test_script(spark, capsys, tmp_path):
    (tmp_path / "a.fb2").write_text(BOOK, encoding="utf-8")
    code, out = run(spark, capsys, "script", tmp_path, "--dry-run")
    found = json.loads(out)
    assert code == 0 and (found["chapters"], found["footnotes"], found["text_blocks"]) == (4, 1, 14)
    assert run(spark, capsys, "script", tmp_path, "-o", tmp_path / "s", "--skip-footnotes", "--ru-model", "v5_ru")[0] == 0
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert rows.filter("text like 'Сноска%'").count() == 0 and {r[0] for r in rows.select("voice").distinct().collect()} == {"kseniya", None}
    assert run(spark, capsys, "script", tmp_path, "--speed", "0")[0] == 1
    assert "v5_ru" in run(spark, capsys, "script", "--list-models")[1] and "kseniya" in run(spark, capsys, "script", "--list-speakers")[1]
