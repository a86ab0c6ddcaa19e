"""Quality rules with risk-controlled thresholds.

Base rules reject texts without substance. Beyond them, four signals (shares of symbols, of repeated lines, of repeated word windows
and of capitals) reject a text above a cutoff. Which cutoffs are tried, and in which order, is read off the labelled bad documents
alone: from no cutoff at all, the next step is the one that rejects most bad documents more. In each group of strata the steps are then
tested in that order on its labelled good documents, and the last is used before the first whose exact (Clopper-Pearson) upper bound
on the share of good documents that all signals together reject exceeds ``alpha``. A test that is reached only after all before it
held (fixed-sequence testing) needs no correction for their number; the error ``delta`` is divided among the groups only, so with
probability ``1 - delta`` no group loses more than ``alpha`` of its good documents. A stratum with too few labelled good documents to
prove anything is joined with its neighbour; the bound then holds for the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from . import textops as T
from .common import cut, keyed, plain

ALPHA, DELTA = 0.05, 0.05
STRATA = (100, 400, 1600)  # upper word counts of the strata but the last
CUTOFFS = {
    "symbols": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25),
    "lines": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeats": (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25),
    "capitals": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of every row of a batch of texts."""
    w = T.Words(raw, offsets)
    rows = w.rows
    in_word = np.zeros(len(raw) + 1, np.int64)
    np.add.at(in_word, w.start, 1)
    np.add.at(in_word, w.end, -1)
    points = (np.cumsum(in_word[:-1]) > 0) & ((raw & 0xC0) != 0x80)
    out = {"n_words": w.counts, "word_chars": w.total(points, offsets), "n_symbols": w.total(_SYMBOL[raw], offsets), "n_capitals": w.total((raw >= 65) & (raw <= 90), offsets)}

    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(raw)]
    row = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.concatenate([start[1:], [len(raw)]]), offsets[row + 1])
    end = end - ((end > start) & (raw[np.maximum(end - 1, 0)] == 10))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    line = w.spans(start, end)
    out["n_lines"] = np.bincount(row, minlength=rows)
    order = np.lexsort((line, row))
    again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=rows)

    win, at = T.windows(w.hashes(), w.first, 8)
    owner = w.row[at]
    order = np.lexsort((win, owner))
    same = (win[order][1:] == win[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(win), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return out


def with_measures(docs: DataFrame) -> DataFrame:
    """``keyed`` docs with ``MEASURES``, a row for each row."""
    source = keyed(docs)
    schema = T_.StructType(source.schema.fields + [T_.StructField(m, T_.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            found = measure(*T.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=[*part.schema.names, *MEASURES])

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def signals() -> dict[str, Column]:
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def proven(rejected: int, n: int, limit: float, error: float) -> bool:
    """The exact upper bound at confidence ``1 - error`` on a rejection rate, ``rejected`` of ``n`` seen, is at most ``limit``."""
    return n > 0 and rejected < limit * n and binomial_at_most(rejected, n, limit) <= error


def steps(bad: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """Rules from the loosest on: for each signal, how many of its cutoffs a text must exceed to be rejected; one more than there are
    is never. ``bad``: how many cutoffs of each signal bad documents exceed, and their number. Without any, all cutoffs come in turn."""
    sizes = tuple(map(len, CUTOFFS.values()))
    rule, out = tuple(n + 1 for n in sizes), []
    if not bad:
        for k in range(max(sizes)):
            for i, n in enumerate(sizes):
                if k < n:
                    rule = rule[:i] + (n - k,) + rule[i + 1 :]
                    out.append(rule)
        return out
    while True:
        kept = [(levels, n) for levels, n in bad if not rejects(rule, levels)]
        nexts = []
        for i in range(len(sizes)):
            level = max((levels[i] for levels, _ in kept), default=0)  # the loosest cutoff of this signal that rejects more
            if level:
                nexts.append((sum(n for levels, n in kept if levels[i] >= level), -i, level))
        if not nexts:
            return out
        _, i, level = max(nexts)
        rule = rule[:-i] + (level,) + rule[1 - i :]
        out.append(rule)


def rejects(rule: tuple[int, ...], levels: tuple[int, ...]) -> bool:
    return any(have >= need for need, have in zip(rule, levels))


def groups(good: list[int], least: int) -> list[list[int]]:
    """Neighbouring strata, joined until each group has ``least`` labelled good documents."""
    out, own = [], []
    for i in range(len(good)):
        own = [*own, i]
        if sum(good[j] for j in own) >= least:
            out, own = [*out, own], []
    return [*out[:-1], out[-1] + own] if out else [own]


def choose(counts: list[tuple[int, int, tuple[int, ...], int]], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """(stratum, signal) to cutoff, from (stratum, quality, cutoffs exceeded by signal, number of documents)."""
    strata = range(len(STRATA) + 1)
    path = steps([(levels, n) for _, quality, levels, n in counts if quality == 0])
    good = [[(levels, n) for s, quality, levels, n in counts if s == i and quality == 1] for i in strata]
    least = math.ceil(math.log(delta / len(strata)) / math.log1p(-alpha))
    parts = groups([sum(n for _, n in rows) for rows in good], least)
    out = {}
    for part in parts:
        rows = [row for i in part for row in good[i]]
        held = None
        for rule in path:
            if not proven(sum(n for levels, n in rows if rejects(rule, levels)), sum(n for _, n in rows), alpha, delta / len(parts)):
                break
            held = rule
        for (name, cutoffs), need in zip(CUTOFFS.items(), held or ()):
            if need <= len(cutoffs):
                out |= {(i, name): cutoffs[need - 1] for i in part}
    return out


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """(stratum, signal) to cutoff. The driver gets a count for each stratum, label and set of cutoffs exceeded, of which there is a
    bounded number."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    levels = [sum(((value > c).cast("int") for c in CUTOFFS[name]), F.lit(0)).alias(name) for name, value in signals().items()]
    rows = measured.join(known, "doc_id").filter(~base_failed()).groupBy(stratum().alias("stratum"), "quality", *levels).agg(F.count("*").alias("n")).collect()
    return choose([(r["stratum"], r["quality"], tuple(r[name] for name in CUTOFFS), r["n"]) for r in rows], alpha, delta)


def rejected(cutoffs: dict[tuple[int, str], float]) -> Column:
    out = F.lit(False)
    for (level, name), cutoff in sorted(cutoffs.items()):
        out = out | ((stratum() == level) & (signals()[name] > cutoff))
    return out


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, the five measures, base_failed, kept) for every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged each. Labels of null or unknown documents
    have no effect; of several labels of a document the lowest counts; without labels only the base rules reject.
    """
    measured = cut(with_measures(docs.select("doc_id", "text")).select("doc_id", *MEASURES))
    cutoffs = thresholds(measured, labels, alpha, delta)
    return measured.select("doc_id", *MEASURES[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected(cutoffs)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``quality_report`` keeps, with all their columns. Texts never pass a shuffle: they are measured once
    for the thresholds and once for the verdict."""
    cutoffs = thresholds(with_measures(docs.select("doc_id", "text")).select("doc_id", *MEASURES), labels, alpha, delta)
    return plain(with_measures(docs).filter(~base_failed() & ~rejected(cutoffs)))
