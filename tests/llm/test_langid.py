"""Language identification: accuracy on rows that were not learned from, calibration, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from fieldbeat.llm import langid, queries


@pytest.fixture(scope="module")
def result(spark):
    sf_dir = "/root/testdata/sf0.01"
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return given, {r["doc_id"]: r for r in queries.op9_language(spark, sf_dir).collect()}


def test_held_out_accuracy(result):
    given, rows = result
    assert set(rows) == set(given)
    held = [i for i, r in rows.items() if r["held_out"]]
    assert set(held) == {i for i in given if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [rows[i]["lang_pred"] == given[i]["lang"] for i in held if given[i]["lang"]]
    assert np.mean(right) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_scores_are_calibrated():
    """Overlapping languages: the mean score agrees with the share of right answers."""
    r = np.random.default_rng(1)

    def row(y):
        text = "".join(r.choice(list("abcd "), p=[0.3, 0.25, 0.2, 0.15, 0.1] if y else [0.25, 0.3, 0.15, 0.2, 0.1]) for _ in range(60))
        return y, *langid.ngrams(text + "a")

    rows = [row(k % 2) for k in range(1500)]
    model = langid.train(["x", "y"], np.ones(langid.BUCKETS), rows[:1000])
    told = [(langid.softmax(model.logits(at, n) / model.temperature), y) for y, at, n in rows[1000:]]
    right = np.mean([p.argmax() == y for p, y in told])
    assert abs(np.mean([p.max() for p, _ in told]) - right) < 0.1 and right > 0.6


def test_penalty_makes_weights_sparse():
    rows = [(k % 2, *langid.ngrams("der die das " * 3 if k % 2 else "the and of " * 3)) for k in range(40)]
    model = langid.train(["de", "en"], np.ones(langid.BUCKETS), rows)
    assert 0 < np.count_nonzero(model.weights) < 300


def test_ngrams():
    at, counts = langid.ngrams("Ab  9b")
    assert counts.sum() == 4 + 3 + 2  # "ab b": letters and spaces, pairs, triples
    assert len(langid.ngrams("12 ,. 😀")[0]) == len(langid.ngrams("")[0]) == 0
    assert langid.ngrams("ÀB!")[0].tolist() == langid.ngrams("àb?")[0].tolist()


def test_odd_rows(make_df):
    schema = "doc_id long, text string, lang string, score string, order int"
    rows = [{"doc_id": i, "text": t, "lang": x} for i, (t, x) in enumerate(
        [("der die das und nicht", "de"), ("the and of that with", "en")] * 20)]
    odd = [None, "", "123 !?", "das und die", "x" * 200_000, "das und die"]
    rows += [{"doc_id": 100 + i, "text": t} for i, t in enumerate(odd)] + [{"text": "of the", "lang": "en"}]
    df = make_df(schema, rows)
    model = langid.fit(langid.learnable(df))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert [(got[100 + i]["lang_pred"], got[100 + i]["score"]) for i in range(3)] == [("und", 0.0)] * 3
    assert got[103]["lang_pred"] == got[105]["lang_pred"] == "de" and got[None]["lang_pred"] == "en"
    nothing = langid.fit(df.limit(0))
    assert nothing.languages == [] and langid.predict(df.limit(1), nothing).first()["lang_pred"] == "und"
    assert langid.fit(df.where("text = ''").selectExpr("doc_id", "text", "'de' AS lang")).languages == []
    one = langid.fit(df.where("lang = 'de'"))
    assert one.predict("anything") == ("de", 1.0)
    assert langid.predict(df.limit(0), model).collect() == []
