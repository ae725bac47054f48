"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(f(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_stages_do_what_brute_force_does(stages):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_operators import brute_lines, brute_print, roots, words_of

    rows = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in stages[:-1]]
    kept = {i for i, _ in rows[1]}
    for i, t in rows[0]:
        w = words_of(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        if len(w) < 50 or 100 * len(inside) > 50 * len(w):
            assert i not in kept
    assert dict(rows[2]) == brute_lines(rows[1])
    prints = [brute_print(t) for _, t in sorted(rows[2])]
    ids = [i for i, _ in sorted(rows[2])]
    found = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(i for i, _ in rows[3]) == sorted({ids[x] for x in found})
    copies = Counter(i for i, _ in rows[4])
    assert set(copies) <= {i for i, _ in rows[3]} and max(copies.values()) <= 2
    pieces = stages[5].groupBy("doc_id").agg(F.count(F.when(F.col("piece") == 0, 1)).alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == dict(copies)


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_near_dedup_takes_five_words_and_similarity(spark):
    """Near copies beyond three bits go, texts within three bits but below 0.8 stay."""
    import numpy as np
    from moodtide.llm.simhash import fingerprint_of

    rng = np.random.default_rng(21)
    texts = []
    for _ in range(40):
        one = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(30, 400))]
        texts.append(one)
        for _ in range(rng.integers(0, 5)):
            two = list(one)
            for at in rng.choice(len(two), max(1, int(len(two) * rng.uniform(0, 0.04))), replace=False):
                two[at] = "changed"
            texts.append(two)
    texts += [[], [], ["a", "b"], ["a", "b"], ["a"], texts[0]]
    order = rng.permutation(len(texts))
    rows = [(i, " ".join(texts[k]) or None, 7) for i, k in enumerate(order.tolist())]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t, _ in rows]
    label = list(range(len(rows)))
    far = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                far += (fingerprint_of(rows[a][1]) ^ fingerprint_of(rows[b][1])).bit_count() > 3
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    for df in (docs, docs.union(docs)):
        got = corpus_pipeline.simhash_near_dedup(spark, df, SF)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(label))
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), SF).count() == 0


def test_near_copies_in_a_list():
    import numpy as np
    from moodtide.llm import copies

    rng = np.random.default_rng(22)
    base = rng.integers(0, 10**9, 300)
    sets = [np.unique(np.where(rng.random(300) < 0.06, rng.integers(0, 10**9, 300), base)).astype(np.uint64) for _ in range(30)]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    label = copies.linked(sets, np.zeros(30, int))
    assert all(label[i] == label[j] for i in range(30) for j in range(i) if near(sets[i], sets[j]))
    sides = copies.linked(sets[:2], np.array([1, 1]))
    assert sides.tolist() == [0, 1]
