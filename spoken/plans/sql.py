"""The register of queries, and builders of their DuckDB counterparts.

The SQL side builds its words from the stems anew (by place, not from tables of whole numbers), so that it checks the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import tables as t
from ..functions import words as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_list(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def under_thousand(n: str) -> str:
    units = f"CASE WHEN {n} % 100 BETWEEN 10 AND 19 THEN {words_list(t.TEENS)}[{n} % 10 + 1] ELSE concat_ws(' ', nullif({words_list(t.TENS)}[{n} // 10 % 10 + 1], ''), nullif({words_list(t.UNITS)}[{n} % 10 + 1], '')) END"
    return f"concat_ws(' ', nullif({words_list(t.HUNDREDS)}[{n} // 100 % 10 + 1], ''), nullif({units}, ''))"


def plural(n: str, forms) -> str:
    return f"CASE WHEN {n} % 10 = 1 AND {n} % 100 <> 11 THEN {quote(forms[0])} WHEN {n} % 10 BETWEEN 2 AND 4 AND {n} % 100 NOT BETWEEN 12 AND 14 THEN {quote(forms[1])} ELSE {quote(forms[2])} END"


def feminine(words: str) -> str:
    return f"regexp_replace(regexp_replace({words}, '(^| )оди́н$', '\\1одна́'), '(^| )два́$', '\\1две́')"


def cardinal(n: str) -> str:
    parts = []
    for power, *forms in t.SCALES:
        c = f"({n} // {10**power} % 1000)"
        words = f"CASE WHEN {c} = 1 THEN NULL ELSE {feminine(under_thousand(c))} END" if power == 3 else under_thousand(c)
        parts.append(f"CASE WHEN {c} > 0 THEN concat_ws(' ', {words}, {plural(c, forms)}) END")
    return f"CASE WHEN {n} = 0 THEN {quote(t.ZERO)} ELSE concat_ws(' ', {', '.join(parts)}, nullif({under_thousand(f'({n} % 1000)')}, '')) END"


def ordinal99(n: str, case: str) -> str:
    """1..99."""
    one = words_list([t.ordinal_form(i, case) for i in range(1, 21)])
    tens = words_list([t.ordinal_form(10 * i, case) for i in range(1, 10)])
    return f"CASE WHEN {n} <= 20 THEN {one}[{n}] WHEN {n} % 10 = 0 THEN {tens}[{n} // 10] ELSE {words_list(t.TENS)}[{n} // 10 + 1] || ' ' || {one}[{n} % 10] END"


def declined(n: str, case: str) -> str:
    """Declined cardinals of 0..99, which a list of them states, and of 1901..1999, which do not change."""
    return f"CASE WHEN {n} < 100 THEN {words_list([W.declined(i, case) for i in range(100)])}[{n} + 1] ELSE {cardinal(n)} END"


def ordinal(n: str, case: str) -> str:
    """Ordinals of 1..99 and 1901..1999, the thousand without its one."""
    return f"CASE WHEN {n} < 100 THEN {ordinal99(n, case)} ELSE 'ты́сяча девятьсо́т ' || {ordinal99(f'({n} - 1900)', case)} END"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def replace_all(text: str, pairs: dict[str, str]) -> str:
    for k, v in pairs.items():
        text = f"replace({text}, {quote(k)}, {quote(v)})"
    return text
