"""Removal of repeats against counting every string."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from fieldbeat.llm import queries, suffix

SF_DIR = "/root/testdata/sf0.001"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    strings = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def rows(df, **sizes):
    found = suffix.remove_repeats(df, **sizes).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found}


@pytest.mark.parametrize(("alphabet", "length", "seed"), [("ab", 12, 3), ("abcd", 10, 3), ("abé", 8, 2)])
def test_against_counting(spark, alphabet, length, seed):
    """Small alphabets make passages meet by chance in every way."""
    r = random.Random(length)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(3, 30))) for _ in range(12)]
    texts = [
        "".join(r.choice(pool) if r.random() < 0.4 else "".join(r.choice(alphabet) for _ in range(r.randrange(6)))
                for _ in range(r.randrange(10)))
        for _ in range(150)]
    texts += ["", None, "a" * 100, "ab" * 30, *texts[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(df, length=length, seed=seed) == dict(enumerate(plain(texts, length)))


def test_hot_passage(spark):
    """A passage in every text, each time between other words, and long runs of one letter."""
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    texts = [
        f"{r.getrandbits(300)}{passage[: r.randrange(190, 231)]}{r.getrandbits(300)}" for _ in range(300)]
    texts += ["z" * 5000, "z" * 150, "z" * 199 + "y" + "z" * 199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(df) == dict(enumerate(plain(texts, 200)))


def test_common_prefixes():
    pairs = [(b"", b""), (b"abc", b"abd"), (b"ab", b"abc"), (b"x", b"y"), (b"same", b"same"), (b"a\0", b"a")]
    assert suffix.common([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [0, 2, 2, 0, 4, 1]


def test_odd_rows(make_df):
    schema = "doc_id long, text string, kept string, k1 int, seed int, spans int"
    assert rows(make_df(schema, [])) == {}
    long = "q" * 150 + "w" * 150
    df = make_df(schema, [{"doc_id": 1}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": long, "k1": 5},
                          {"doc_id": 3, "text": long, "k1": 5}, {"text": "short"}, {"doc_id": 4, "text": "short"}])
    found = suffix.remove_repeats(df)
    assert found.columns == ["doc_id", "k1", "seed", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted((str(r["doc_id"]), r["k1"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found.collect())
    assert got == [("1", None, 0, 0, 0), ("2", None, 0, 0, 0), ("3", 5, 300, 300, 1), ("3", 5, 300, 300, 1),
                   ("4", None, 5, 0, 0), ("None", None, 5, 0, 0)]


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {
        (d["doc_id"], *w[:3], hashlib.sha256(w[3]).hexdigest())
        for d, w in zip(docs, plain([d["text"] for d in docs], 200), strict=True)}
    assert {tuple(r) for r in queries.op10_suffix(spark, SF_DIR).collect()} == want
