"""Operators beyond SQL against plain Python: quality measures, language ranks and distances, paraphrased leaks, secret findings, mixing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoken.llm import decontaminate as D
from spoken.llm import langid, mixing, secrets
from spoken.llm import textops as T
from spoken.llm.quality import quality_report

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- op5 ----------------------------------------------------------------------------------------------------------------------------------
def measured(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def test_quality_measures(spark, docs, texts):
    rows = quality_report(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = measured(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        failed = n < 20 or 100 * repeats > 30 * n
        assert r["base_failed"] == failed and not (failed and r["kept"])


# --- op7 ----------------------------------------------------------------------------------------------------------------------------------
def grams(text):
    """n-grams of letters, words padded by one blank, by the definition."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        out.update(word)
        padded = f" {word} "
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_language_ranks_and_distances(spark, texts):
    some = [t for _, t in sorted(texts.items())[:60]] + [None, "", "12", "ÉÀ Œ ß", "a b"]
    row, code, n = langid.ngrams(some)
    for i, text in enumerate(some):
        want = grams(text)
        assert sorted(n[row == i].tolist()) == sorted(want.values()), i  # each n-gram has a hash of its own
    names, profiles = {}, {}
    for i, text in enumerate(some):  # which hash is which n-gram: by counts that occur once
        for k, c in zip(code[row == i].tolist(), n[row == i].tolist()):
            names.setdefault(k, set()).add(c)
    ranked = langid.ranks(row, code, n, 50)
    for i, text in enumerate(some):
        own = [(int(c), int(k)) for k, c in zip(code[row == i], n[row == i])]
        top = sorted(own, key=lambda x: (-x[0], x[1] >> 12))[:50]
        got = ranked[1][ranked[0] == i].tolist()
        assert sorted(-c for c, _ in top) == sorted(-dict((k, c) for c, k in own)[g] for g in got) and len(got) == len(top)
    # distances, by the definition, for profiles made of two of the texts
    profiles = {lang: langid.ranks(*langid.ngrams([text]), 300)[1].tolist() for lang, text in (("aa", some[0]), ("bb", some[1]))}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify_language(df, profiles).collect()}
    for i, text in enumerate(some):
        own = langid.ranks(*langid.ngrams([text]), 300)[1].tolist()
        if not own:
            assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
            continue
        places = {lang: {g: k for k, g in enumerate(p)} for lang, p in profiles.items()}
        mean = {lang: sum(abs(places[lang][g] - k) if g in places[lang] else 300 for k, g in enumerate(own)) / len(own) / 300 for lang in profiles}
        best = min(sorted(mean), key=mean.get)
        odds = sum(np.exp(-langid.SHARPNESS * (m - mean[best])) for m in mean.values())
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - 1 / odds) < 1e-9


# --- op1 ----------------------------------------------------------------------------------------------------------------------------------
def test_recall_of_paraphrases(spark, docs, texts, monkeypatch):
    """Planted copies with a part of their words replaced: what the search finds of what the exhaustive search accepts."""
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    rng = random.Random(3)
    hosts = [t for _, t in sorted(texts.items()) if t and 200 < len(t.split()) < 600]
    vocabulary = [w for t in hosts for w in t.split()]
    planted, rates = [], (0.0, 0.1, 0.2, 0.3)
    for k, (item, text) in enumerate(items):
        for rate in rates:
            host = hosts[(7 * k + int(10 * rate)) % len(hosts)].split()
            at = rng.randrange(len(host))
            words = [rng.choice(vocabulary) if rng.random() < rate else w for w in text.split()]
            planted.append((item, rate, " ".join(host[:at] + words + host[at:])))
    idf = D._idf(docs)
    space = D.latent_space(docs, idf)
    batch = [t.encode() for *_, t in planted]
    raw, offsets = np.frombuffer(b"".join(batch), np.uint8), np.cumsum([0, *map(len, batch)])
    for direct in (D.DIRECT, 8):  # as it is, and with cells for a benchmark of this size
        monkeypatch.setattr(D, "DIRECT", direct)
        pieces = D.Pieces(items, idf, space)
        every = {(r, i) for r, i, *_ in D.find(raw, offsets, pieces, idf, space, exhaustive=True)}
        found = {(r, i) for r, i, *_ in D.find(raw, offsets, pieces, idf, space)}
        assert found <= every and len(found) >= 0.9 * len(every)
        for rate, least in zip(rates, (1.0, 0.97, 0.85, 0.6)):
            own = [k for k, (_, r, _) in enumerate(planted) if r == rate]
            assert sum((k, planted[k][0]) in found for k in own) >= least * len(own), rate
        assert len(found - {(k, planted[k][0]) for k in range(len(planted))}) <= 0.02 * len(planted)


def test_items_without_weight_are_found(spark):
    rows = [(i, f"the of and to in a is that it was number{i} for on are as with his they at be word{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the of and to in a is that it was"), (2, "quite other words stand in here today")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.benchmark_leaks(docs, items).collect()} == {(i, 1) for i in range(300)}


def test_subsequence_by_definition():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(masks, len(a), b) == table[-1][-1]


# --- op4 ----------------------------------------------------------------------------------------------------------------------------------
def test_findings_of_plain_python(spark, docs, texts):
    """The same candidates as Python's own patterns cut out of the whole texts."""
    forest = secrets.train(secrets.labelled_findings(spark))
    rows = secrets.scan_secrets(docs, forest).collect()
    got = sorted((r["doc_id"], r["nth"], r["candidate_sha256"], r["length"]) for r in rows)
    want = []
    for i, text in texts.items():
        for k, m in enumerate(re.finditer(secrets.CANDIDATE, (text or "").replace("\x01", " "))):
            own = m[2] or m[4] or m[5]
            want.append((i, k, hashlib.sha256(own.encode()).hexdigest(), len(own)))
    assert got == sorted(want) and len(got) > 20
    assert all(r["is_secret"] == (r["score"] >= secrets.THRESHOLD) for r in rows)


def test_forest_on_findings_it_has_not_seen(spark):
    """Precision and recall on findings of other counters than those it was trained on, and the forest by the definition."""
    forest = secrets.train(secrets.labelled_findings(spark))
    other = secrets.labelled_findings(spark, 3 * secrets.FINDINGS).limit(10**9).withColumn("n", F.monotonically_increasing_id()).filter(F.xxhash64("candidate") % 3 != 0)
    seen = secrets.labelled_findings(spark).select("candidate", "before").distinct()
    other = other.join(seen, ["candidate", "before"], "left_anti")
    values = secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = other.select("secret", F.struct(*(c.alias(k) for k, c in values.items())).alias("x")).withColumn("score", secrets.probability(forest, F.col("x"))).collect()
    hit = [r for r in rows if r["score"] >= secrets.THRESHOLD]
    right = sum(r["secret"] == 1 for r in hit)
    assert len(rows) > 1000 and right >= 0.97 * len(hit) and right >= 0.97 * sum(r["secret"] == 1 for r in rows)

    def tree(node, x):
        while isinstance(node, tuple):
            node = node[2] if x[secrets.FEATURES[node[0]]] <= node[1] else node[3]
        return node

    assert all(abs(r["score"] - sum(tree(t, r["x"]) for t in forest) / len(forest)) < 1e-9 for r in rows[:500])


# --- op6 ----------------------------------------------------------------------------------------------------------------------------------
def test_mix_follows_its_targets(docs, texts):
    rows = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(WORDS.findall(t or "")) for i, t in texts.items()}
    sizes, taken = Counter(), Counter()
    for i, r in rows.items():
        assert r["size"] == size[i] and 0 <= r["taken"] <= 3 * size[i]
        sizes[source[i]] += size[i]
        taken[source[i]] += r["taken"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    want = share | fixed
    for s in names:
        assert all(abs(r["target"] - want[s]) < 1e-6 * want[s] + 1e-6 and r["source_size"] == sizes[s] for i, r in rows.items() if source[i] == s)
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 * mixing.BLOCK


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(out.tolist()) == list(range(n))


# --- textops --------------------------------------------------------------------------------------------------------------------------------
def test_words_and_windows(texts):
    import pyarrow as pa

    some = [t for _, t in sorted(texts.items())[:100]] + [None, "", " \t", "é b c", "x" * 1000]
    w = T.Words(*T.buffers(pa.array(some, pa.string())))
    assert w.counts.tolist() == [len(WORDS.findall(t or "")) for t in some]
    h = w.hashes()
    by_word = {}
    for i, t in enumerate(some):
        for word, x in zip(WORDS.findall(t or ""), h[w.first[i] : w.first[i + 1]].tolist()):
            assert by_word.setdefault(word, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_recall_where_the_space_is_fitted_on_a_part(spark, docs, monkeypatch):
    """The latent space alone comes from a sample, here an eighth of the documents; whatever the space, frequencies count all passages and
    all windows are searched, and of the exhaustive search's leaks at least 0.9 are found."""
    monkeypatch.setattr(D, "FIT_DOCS", 125)
    monkeypatch.setattr(D, "FIT_PASSAGES", 2000)
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    idf = D._idf(docs)
    space = D.latent_space(docs, idf)
    rows = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    raw, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    pieces = D.Pieces(items, idf, space)
    every = {(r, i) for r, i, *_ in D.find(raw, offsets, pieces, idf, space, exhaustive=True)}
    found = {(r, i) for r, i, *_ in D.find(raw, offsets, pieces, idf, space)}
    assert every and found <= every and len(found) >= 0.9 * len(every)
