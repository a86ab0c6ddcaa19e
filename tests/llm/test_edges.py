"""Cases at the edges: hot tiles and size bands of the join, long and repeated turns, toxicity without labels, the checkpoint folder."""

import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from spoken.llm import common, mixing, ngram_join
from spoken.llm.chat import chat_digest, format_chat
from spoken.llm.toxicity import score_toxicity


def _components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_hot_tiles_and_band_edges(spark, monkeypatch):
    """A phrase in every text, sets at the edges of size bands, and tiles dealt over tasks: the same links as by brute force."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 3)
    rng = random.Random(8)
    common_words = [f"c{i}" for i in range(40)]
    base = [f"b{i}" for i in range(120)]
    texts = []
    for n in (4, 5, 6, 7, 8, 12, 16, 21, 28, 37, 49, 64, 65, 66, 84, 85, 86, 87, 112):  # 4/3 apart, and beside
        texts.append(base[:n])
    for i in range(60):
        texts.append(common_words + [f"u{i}_{k}" for k in range(rng.choice((0, 5, 9, 10, 11, 12, 13, 14, 40)))])
    rng.shuffle(texts)
    words = [" ".join(t) for t in texts]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, _components(sets)))}


def test_packed_keys_are_whole():
    import numpy as np

    keys = np.array([0, 1, 2**56 - 1, 2**63 + 12345, 2**64 - 1], np.uint64)
    packed = ngram_join._pack(keys)
    assert ((ngram_join._unpack(packed.ravel()) | (keys >> np.uint64(56) << np.uint64(56))) == keys).all()


def test_long_repeated_and_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, seq int, loss string, error string"
    long = "слово \\ </s> " * 50_000
    rows = [(1, 0, "user", long, 1, "x", "y"), (1, 1, "assistant", long, 1, "x", "y"), (2, 0, "user", "a", 1, None, None), (2, 0, "user", "a", 1, None, None), (3, None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat_digest(format_chat(turns)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[1]["valid"]
    assert got[2]["n_turns"] == 2 and not got[2]["valid"] and got[2]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\n").hexdigest()
    assert got[3]["n_turns"] == 1 and got[3]["loss_chars"] == 0
    assert chat_digest(format_chat(turns.limit(0))).count() == 0


def test_toxicity_without_labels(spark):
    """The lexicon alone: it finds texts with its words, and accuses few others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score_toxicity(docs, labels.limit(0)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    english = [r for r in rows if r["toxic"] == 1 and r["lang"] == "en"]
    fine = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in english) >= 0.8 * len(english)
    assert sum(r["predicted"] for r in fine) <= 0.02 * len(fine)


def test_sources_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(docs)


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def __getattr__(self, name):
            return lambda *a: self

        def isDefined(self):
            return False

        def get(self, *a):
            return None

    class Context(Nothing):
        master = "spark://host:7077"
        _jsc = Nothing()

        def getConf(self):
            return Nothing()

    class Session(Nothing):
        sparkContext, conf = Context(), Nothing()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.ensure_checkpoint_dir(Session())


def test_rounds_write_few_files(spark):
    """The join's rounds write narrow results, whose files must not grow with the shuffle partitions one for one."""
    common.ensure_checkpoint_dir(spark)
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    seen = set(folder.glob("rdd-*"))
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        texts = [" ".join(f"w{i // 3}_{k}" if k != i % 3 else "other" for k in range(60)) for i in range(300)]
        rows = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i // 3 * 3 for i in range(300)}
    parts = [len(list(p.glob("part-*"))) for p in folder.glob("rdd-*") if p not in seen]
    assert len(parts) > 4 and max(parts) <= 8
