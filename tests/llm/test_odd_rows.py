"""Null ids, repeated rows, empty and very long texts in operators and in the pipeline as a whole."""

from collections import Counter

import pytest

from moodtide.llm import lines, mixing, quality, simhash, urls

pytest.importorskip("public_tokenizers")
LONG = "word and some more words, then others. " * 30_000
ROWS = [(1, LONG, "en", "a", 5), (1, LONG, "en", "a", 5), (None, "x y z", "en", None, 5), (None, None, "de", "b", 0), (2, "", None, "b", 0), (3, "x y z", "en", None, 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_operators_keep_odd_rows_apart(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    measured = quality.ledger(docs).collect()
    assert len(measured) == len(ROWS) and Counter(r.m.n_words for r in measured) == Counter({210_000: 2, 3: 2, 0: 2})
    assert len(mixing.mix(docs).collect()) == len(ROWS)
    assert lines.dedup_lines(docs).count() == len(ROWS)
    kept = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in kept} >= {1} and len(kept) < len(ROWS)
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, None), (None, "http://b.org/es/" + "x" * 200_000), (4, "")], "page_id long, url string")
    judged = urls.judge(pages, urls.rule_table(spark)).collect()
    assert Counter((r.page_id, r.rule) for r in judged) == Counter([(1, "com/en/"), (1, "com/en/"), (None, None), (None, "org/es/"), (4, None)])


def test_the_pipeline_takes_odd_tables(spark, tmp_path):
    import corpus_pipeline

    good = " ".join(f"plain{i} text{i} here" for i in range(40))
    rows = [*ROWS, (7, good, "en", "a", 900), (7, good, "en", "a", 900), (8, good + " more", "en", "b", 905), (None, good.upper(), "en", None, 900)]
    for name, part in (("odd", rows), ("empty", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame([(*r, "mine", 1) for r in part], SCHEMA + ", sequence_id string, size int").write.parquet(str(tmp_path / name / "documents.parquet"))
        made = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(made) == bool(part)
        assert all(r.length <= 2048 for r in made) and made == [] or {r.doc_id for r in made} <= {None, 1, 7, 8}
