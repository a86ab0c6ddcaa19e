"""Toxicity by weak supervision.

Voters (groups of a small lexicon, words that labelled rows associate with toxicity, and patterns) fire or stay silent on a text. A
generative model of the votes is fitted by expectation maximisation: for each voter its rates of firing on toxic and on other texts,
with known labels held fixed; correlations of voters within a class are estimated from its posteriors, and a voter's evidence is
divided by the number of voters it effectively repeats. The posteriors of all sampled texts, labelled or not, then train a linear
classifier over hashed words and votes, which scores every whole text. Held-out rows are never sampled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import held_out

BITS = 22  # of a feature's slot in the classifier
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning
LEVELS = ((1, 0), (2, 1), (3, 3))  # (occurrences, percent of the words) at least
SAMPLE_LABELLED, SAMPLE_OTHER = 5000, 2000  # texts to learn from
MINED, MIN_DOCS, MIN_Z = 96, 5, 6.0
MIN_TOLD = 4.0  # standard deviations
BELIEF = 20.0
_ROWS = 4096
THRESHOLD = 0.3
#: The lexicon by voter: common insults and threats of four languages, without words that are harmless in another of them.
LEXICON = {
    "intellect": "idiot idiots stupid moron morons imbecile dumb fool dimwit halfwit",
    "contempt": "pathetic worthless disgusting trash garbage scum filth loser losers vermin",
    "mockery": "clown clowns coward cowards freak pig",
    "wishes": "kill hate hurt destroy",
    "french": "connard salaud imbécile débile crétin ordure minable abruti",
    "german": "dummkopf arschloch trottel abschaum wertlos widerlich vollidiot",
    "spanish": "estúpido imbécil basura asqueroso inútil cretino escoria payaso",
}
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False


def _codes(hashes: np.ndarray, level: int) -> np.ndarray:
    """A feature's code: 52 bits of a word's or prefix's hash, and a level of its frequency in the text."""
    return T.mix((hashes >> np.uint64(12)) * np.uint64(4) + np.uint64(level))


def _lexicon() -> list[np.ndarray]:
    out = []
    for words in LEXICON.values():
        raw = np.frombuffer(words.encode(), np.uint8)
        out.append(np.unique(_codes(T.Words(raw, np.array([0, len(raw)])).hashes(), 0)))
    return out


class Features:
    """Distinct words and word beginnings of each row (code, row), and pattern votes. A beginning has further codes where it is
    frequent in its text, so that classifier and voters can tell an accident from a habit."""

    def __init__(self, column: pa.Array):
        raw, offsets = T.buffers(column)
        w = T.Words(raw, offsets, lower=True, space=_NOT_LETTER)
        code, row = [], []
        for k in (0, *PREFIXES):
            some = slice(None) if not k else w.end - w.start > k
            start, owner = w.start[some], w.row[some]
            h = w.spans(start, start + k if k else w.end[some])
            key = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
            key, count = key[edge[:-1]], np.diff(edge)
            owner, h = (key >> np.uint64(52)).astype(np.int64), key << np.uint64(12)
            for level, (least, percent) in enumerate(LEVELS if k else LEVELS[:1]):
                fits = (count >= least) & (100 * count >= percent * w.counts[owner])
                code.append(_codes(h[fits], level))
                row.append(owner[fits])
        self.code, self.row, self.n = np.concatenate(code), np.concatenate(row), w.rows
        self.slot = (self.code >> np.uint64(64 - BITS)).astype(np.int32)
        words = np.maximum(w.counts, 1)
        letters = w.total(~_NOT_LETTER[raw], offsets)
        capitals = w.total((raw >= 65) & (raw <= 90), offsets)
        marks = w.total(raw == 33, offsets)
        double = np.zeros(len(raw), bool)
        if len(raw) > 1:
            double[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
        self.patterns = np.stack([2 * capitals > np.maximum(letters, 1), 10 * marks > words, w.total(double, offsets) > 0], axis=1)

    def votes(self, groups: list[np.ndarray], mined: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(groups) + len(mined) + self.patterns.shape[1]), bool)
        for i, words in enumerate(groups):
            out[self.row[np.isin(self.code, words)], i] = True
        if len(mined):
            at = np.minimum(np.searchsorted(mined, self.code), len(mined) - 1)
            hit = mined[at] == self.code
            out[self.row[hit], len(groups) + at[hit]] = True
        out[:, len(groups) + len(mined) :] = self.patterns
        return out


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(posterior of each row, weight of a fired and of a silent vote, prior). ``known`` is 1, 0 or -1; labels stay fixed. So that the
    classes keep their meaning where labels are few or none, ``BELIEF`` texts of each class are believed beforehand: toxic ones of
    which lexicon voters fire on a fifth, others on which they hardly fire, and the other voters as often as on all texts."""
    seen = known >= 0
    y = np.where(seen, known, 0).astype(float)
    prior = (known == 1).sum() / max(1, seen.sum()) if seen.any() else 0.05
    y[~seen] = np.where(votes[~seen][:, : len(LEXICON)].any(axis=1), 0.7, 0.02)
    fire = np.zeros((2, votes.shape[1]))
    v = votes.astype(float)
    share = np.ones(votes.shape[1])
    believed = np.tile(np.clip(v.mean(axis=0), 1e-3, 0.999), (2, 1))
    believed[:, : len(LEXICON)] = [[0.002], [0.2]]
    for _ in range(rounds):
        for c, weight in ((1, y), (0, 1 - y)):
            fire[c] = (weight @ v + BELIEF * believed[c]) / (weight.sum() + BELIEF)
        # correlations within the classes, each text in its likelier one (what both share would count as agreement): a voter's evidence
        # is shared with those that repeat it
        kept = np.zeros((votes.shape[1],) * 2)
        hard = (y >= 0.5).astype(float)
        for c, weight in ((1, hard), (0, 1 - hard)):
            weight = weight / max(weight.sum(), 1e-9)
            centred = (v - weight @ v) * np.sqrt(weight)[:, None]
            cov = centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            kept = np.maximum(kept, np.maximum(0, cov / np.outer(sd, sd)))
        share = 1 / np.maximum(1, np.where(kept > 0.25, kept, 0).sum(axis=1) - np.diag(np.where(kept > 0.25, kept, 0)) + 1)
        on, off = share * np.log(fire[1] / fire[0]), share * np.log((1 - fire[1]) / (1 - fire[0]))
        prior = min(0.9, max(1e-3, y.mean()))
        z = np.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        y = np.where(seen, known, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    z = np.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
    soft = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.where(seen, 0.5 * known + 0.5 * soft, soft), on, off, prior


def _fit(row: np.ndarray, slot: np.ndarray, n: int, target: np.ndarray, rounds: int = 200, decay: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on distinct slots by Adam, full batches; a slot's value is 1."""
    weight, bias = np.zeros(slot.max(initial=0) + 1), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m = s = np.zeros_like(weight)
    mb = sb = 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=weight[slot], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g, gb = np.bincount(slot, weights=error[row], minlength=len(weight)) / n + decay * weight, float(error.mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        weight = weight - rate * (m / c) / (np.sqrt(s / d) + 1e-6)
        bias -= rate * (mb / c) / (np.sqrt(sb / d) + 1e-6)
    return weight, bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn z into probabilities of y: Newton steps on smoothed targets."""
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p))
        w = w + np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


class Model:
    """The classifier: weights of the slots that tell anything, and of the votes. Only these are sent; a worker spreads them once."""

    def __init__(self, groups, mined, slots, weight, votes, bias, scale=1.0, shift=0.0):
        self.groups, self.mined, self.slots, self.weight, self.votes = groups, mined, slots, weight, votes
        self.bias, self.scale, self.shift = bias, scale, shift
        self._table = None

    def score(self, f: Features) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.slots] = self.weight
        z = np.bincount(f.row, weights=self._table[f.slot], minlength=f.n) + self.bias
        z += f.votes(self.groups, self.mined) @ self.votes
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _mine(f: Features, known: np.ndarray) -> np.ndarray:
    """Codes of words and beginnings that toxic labelled rows have far more often, sorted. Slots are counted first, then the codes of
    those slots that may have one."""
    n1, n = int((known == 1).sum()), int((known >= 0).sum())
    if not 0 < n1 < n:
        return np.zeros(0, np.uint64)
    bad = np.bincount(f.slot[(known == 1)[f.row]], minlength=1 << BITS)
    near = (bad >= MIN_DOCS)[f.slot] & (known >= 0)[f.row]
    words, at = np.unique(f.code[near], return_inverse=True)
    row = f.row[near]
    bad, total = np.bincount(at, weights=known[row] == 1, minlength=len(words)), np.bincount(at, minlength=len(words))
    expected = total * n1 / n
    z = (bad - expected) / np.sqrt(np.maximum(expected * (1 - n1 / n), 1e-9))
    pick = np.flatnonzero((bad >= MIN_DOCS) & (z >= MIN_Z) & (2 * bad > total))
    pick = pick[np.argsort(-z[pick], kind="stable")[:MINED]]
    return np.sort(words[pick])


def learn(docs: DataFrame, labels: DataFrame, labelled: int = SAMPLE_LABELLED, other: int = SAMPLE_OTHER) -> Model:
    """Fits on at most about ``labelled`` texts with and ``other`` texts without label, by a hash of doc_id, held-out rows excepted.
    Their distinct word hashes reach the driver, a bounded amount. Of several labels of a document the highest counts."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))
    n = ids.count()
    n_known = known.filter(~held_out(F.col("doc_id"))).count()
    some = known.filter(~held_out(F.col("doc_id"))).filter(at < (1 << 24) * min(1.0, labelled / max(1, n_known)))
    near = ids.filter(at < (1 << 24) * min(1.0, (labelled + other) / max(1, n))).join(known, "doc_id", "left_anti").withColumn("toxic", F.lit(-1))
    near = near.limit(2 * (labelled + other))  # of a sample: bounds what repeated ids can add
    wanted = F.broadcast(some.limit(2 * labelled).unionByName(near).dropDuplicates(["doc_id"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", rows=_ROWS):
            f = Features(part.column("text"))
            order = np.argsort(f.row, kind="stable")
            code, bounds = f.code[order], np.searchsorted(f.row[order], np.arange(f.n + 1))
            packed = [code[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
            flags = [p.astype(np.uint8).tobytes() for p in f.patterns]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(packed, pa.binary()), pa.array(flags, pa.binary())], names=["doc_id", "toxic", "words", "flags"])

    rows = texts.select("doc_id", "toxic", "text").mapInArrow(words, "doc_id long, toxic int, words binary, flags binary")
    each, flags, label, order = [], [], [], []
    for r in rows.toLocalIterator():  # a bounded sample; its codes only
        codes = bytes(r["words"])
        order.append((r["doc_id"], zlib.crc32(codes), len(order)))
        each.append(np.frombuffer(codes, np.uint64))
        flags.append(np.frombuffer(bytes(r["flags"]), np.uint8))
        label.append(r["toxic"])
    order = [i for *_, i in sorted(order)]
    groups = _lexicon()
    f = Features.__new__(Features)
    f.n = len(each)
    seen = np.zeros(1 << BITS, np.uint16)
    for codes in each:
        seen[codes >> np.uint64(64 - BITS)] += 1
    each = [each[i][seen[each[i] >> np.uint64(64 - BITS)] >= 3] for i in order]  # what fewer texts have cannot be learned
    f.row = np.repeat(np.arange(f.n, dtype=np.int32), [len(x) for x in each])
    f.code = np.concatenate(each) if each else np.zeros(0, np.uint64)
    del each, seen
    f.slot = (f.code >> np.uint64(64 - BITS)).astype(np.int32)
    f.patterns = np.array([flags[i] for i in order], bool).reshape(f.n, 3)
    label = np.array([label[i] for i in order], np.int64)
    mined = _mine(f, label)
    votes = f.votes(groups, mined)
    if not f.n:
        return Model(groups, mined, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(votes.shape[1]), -3.0)
    target, *_ = label_model(votes, label)
    # the classifier sees votes and those words and beginnings whose association with the posteriors is no accident
    seen = np.bincount(f.slot, minlength=1 << BITS)
    z = (np.bincount(f.slot, weights=target.astype(np.float32)[f.row], minlength=1 << BITS) - seen * target.mean()) / np.sqrt(np.maximum(seen * target.var(), 1e-9))
    told = (np.abs(z) >= MIN_TOLD) & (seen >= MIN_DOCS)
    slots, place = np.flatnonzero(told).astype(np.int32), np.cumsum(told) - 1
    keep = told[f.slot]
    row, at = f.row[keep].astype(np.int64), place[f.slot[keep]]
    del f
    r, c = np.nonzero(votes)
    weight, bias = _fit(np.concatenate([row, r]), np.concatenate([at, len(slots) + c]), len(label), target)
    weight = np.concatenate([weight, np.zeros(len(slots) + votes.shape[1] - len(weight))])
    # Platt scaling on the labelled rows of the sample
    z = np.bincount(row, weights=weight[at], minlength=len(label)) + bias + votes @ weight[len(slots) :]
    seen = label >= 0
    a, b = _platt(z[seen], label[seen] == 1)
    return Model(groups, mined, slots, weight[: len(slots)].astype(np.float32), weight[len(slots) :], bias, max(a, 1e-3), b)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Null and empty texts are scored like any text without words; texts are read whole. Repeated rows are scored each; a null doc_id is
    not held out; other columns are ignored. Without labels lexicon and patterns alone train the model, which then knows little beyond
    the lexicon; without documents the result is empty.
    """
    model = learn(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights that are not 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", rows=_ROWS):
            p = shared.value.score(Features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p.astype(float)), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
