"""Language identification by rank-order profiles.

A profile is the ``profile`` most frequent letter n-grams (1 to 3, words padded by one blank) in order of frequency. A document's
own profile is compared with each language's by the out-of-place distance: the sum of rank differences, with the profile length for
an n-gram the language does not list. Languages are learned from a bounded sample of labelled rows; all documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import held_out

PROFILE, ORDERS = 300, (1, 2, 3)
SAMPLE = 2000  # documents a language to learn from
SHARPNESS = 20.0
UNKNOWN = "und"
_SLICE_ROWS = 4096
_HASH_BITS = 44
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram hash, count) of all texts, sorted by row and hash."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in lowered], np.int64))
    letter = _letter_table()[codes]
    # one blank before, between and after words; a row's words keep apart from the next row's by its final line break
    before = np.concatenate([[True], ~letter[:-1]]) if len(letter) else letter
    keep = letter | ~before
    seq, row, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    keys = []
    tag = lambda h, r: (r.astype(np.uint64) << np.uint64(_HASH_BITS)) | (T.mix(h) >> np.uint64(64 - _HASH_BITS))
    if 1 in ORDERS:
        keys.append(tag(seq[letter], row[letter]))
    left = np.concatenate([np.zeros(1, np.uint64), seq[:-1]]) if len(seq) else seq  # a blank before the first word
    if 2 in ORDERS:
        two = (left > 0) | (seq > 0)
        keys.append(tag(((left << np.uint64(21)) | seq)[two] | np.uint64(1 << 62), row[two]))
    if 3 in ORDERS and len(seq) > 1:
        three = (left[:-1] > 0) & (seq[1:] > 0) | (seq[:-1] > 0)
        three &= seq[:-1] > 0  # words stay apart: the middle is a letter
        keys.append(tag(((left[:-1] << np.uint64(42)) | (seq[:-1] << np.uint64(21)) | seq[1:])[three] ^ np.uint64(1 << 63), row[:-1][three]))
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]])) if len(every) else np.zeros(1, np.int64)
    distinct = every[edge[:-1]]
    return (distinct >> np.uint64(_HASH_BITS)).astype(np.int64), distinct & np.uint64((1 << _HASH_BITS) - 1), np.diff(edge)


def ranks(row: np.ndarray, grams: np.ndarray, counts: np.ndarray, profile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank) of each row's most frequent n-grams; ties by hash."""
    top = np.uint64((1 << 20) - 1)
    key = (row.astype(np.uint64) << np.uint64(52)) | ((top - np.minimum(counts.astype(np.uint64), top)) << np.uint64(32)) | (grams >> np.uint64(12))
    order = np.argsort(key)
    row, grams = row[order], grams[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    keep = at < profile
    return row[keep], grams[keep], at[keep]


def learn(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, list[int]]:
    """Language to its n-gram hashes by rank, from rows with a language that are not held out; at most about ``sample`` documents
    a language, taken by a hash of doc_id. ``profile`` numbers a language reach the driver."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))
    taken = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", rows=_SLICE_ROWS):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            row, grams, n = ngrams(part.column("text").to_pylist())
            for lang in sorted(set(langs.tolist())):
                own = (langs == lang)[row]
                if own.any():
                    distinct, at = np.unique(grams[own], return_inverse=True)
                    sums = np.bincount(at, weights=n[own]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), pa.array(distinct.astype(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])

    sums = taken.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify_language(docs: DataFrame, profiles: dict[str, list[int]] | None = None, profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text[, lang])``.

    ``lang_pred`` is the language of least distance (ties: first by code point), or ``und`` for null texts, texts without a letter,
    and all texts where nothing was learned; their score is 0. ``score`` is the softmax of the negative mean distances at the chosen
    language. Repeated rows are scored each; a null doc_id is not held out.
    """
    profiles = learn(docs, profile=profile) if profiles is None else profiles
    langs = sorted(profiles)
    listed = np.unique(np.array([g for lang in langs for g in profiles[lang]], np.uint64)) if langs else np.zeros(0, np.uint64)
    table = np.full((len(langs), len(listed) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        table[i, np.searchsorted(listed, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", rows=_SLICE_ROWS):
            n = part.num_rows
            row, grams, at = ranks(*ngrams(part.column("text").to_pylist()), profile)
            pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            seen = np.bincount(row, minlength=n)
            if langs:
                where = np.minimum(np.searchsorted(listed, grams), len(listed) - 1)
                where[listed[where] != grams] = len(listed)
                distance = np.empty((n, len(langs)))
                for i in range(len(langs)):
                    rank = table[i, where]
                    distance[:, i] = np.bincount(row, weights=np.where(rank < 0, profile, np.abs(rank - at)), minlength=n)
                distance /= np.maximum(seen, 1)[:, None] * float(profile)
                best = distance.argmin(axis=1)
                odds = np.exp(-SHARPNESS * (distance - distance.min(axis=1, keepdims=True)))
                some = seen > 0
                pred[some] = np.array(langs, dtype=object)[best[some]]
                score[some] = (1 / odds.sum(axis=1))[some]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
