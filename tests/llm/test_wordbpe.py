"""Encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
import regex
from tokenizers import Tokenizer

from fieldbeat.llm import queries, wordbpe

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = wordbpe.read_vocabulary(queries.WORDS_FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORDS_FILE)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def flat(text):
    words = VOCABULARY.words(
        text, regex.compile(VOCABULARY.pattern).findall, regex.compile(VOCABULARY.rare))
    return [i for ids in VOCABULARY.encode(words) for i in ids]


def test_guesses_and_merges(library):
    r = random.Random(1)
    words = ["".join(r.choice("aabeinrst") if r.random() < 0.9 else r.choice("é-=ßжÿ1")
                     for _ in range(r.randrange(1, 30))) for _ in range(5000)]
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [flat(w) for w in words] == want
    spelled = [VOCABULARY.spelled(w) for w in words if w.isalpha()]
    assert [VOCABULARY.merged(w) for w in spelled] == [w for w in VOCABULARY.encode(
        [w for w in words if w.isalpha()])]


def test_both_ways_occur():
    """The guess alone would be wrong for some words and is right for others."""
    words = ["zurich", "xylophonist", "bananas", "counterrevolutionaries", "thesis", "aaaaaaa", "statesthe"]
    wrong = [w for w in words if VOCABULARY.guess(w) != VOCABULARY.merged(w)]
    assert 0 < len(wrong) < len(words)
    assert VOCABULARY.encode(words) == [VOCABULARY.merged(w) for w in words]


def test_every_character(library):
    """All characters, also those that only newer Unicode tables know."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"x{c}1 {c}{c} a{c}́b" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, want, strict=True) if flat(t) != w] == []


def test_odd_rows(make_df, library):
    texts = [None, "", " \n\t", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>x <|END", "né 😀 東京",
             "ΑΣ ΑΣ. İx", "é it's I'LL don't", "x" * 30_000 + " y", "ab" * 20_000, "\x00\x7f\x1c a", "b", "b",
             "\U0001fae8 Ᲊ \U00033000 née"]
    df = make_df("doc_id long, text string, ids string, decoded int, vocabulary string",
                 [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    once = wordbpe.encode_and_decode(df, VOCABULARY)
    apart = wordbpe.decode(wordbpe.encode(df, VOCABULARY), VOCABULARY)
    assert once.columns == ["doc_id", "vocabulary", "ids", "decoded"]
    assert once.exceptAll(apart.select(*once.columns)).isEmpty()
    rows = {r["doc_id"]: r for r in apart.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == ids_of(library, text or "")
        assert rows[i]["decoded"] == library.decode(rows[i]["ids"], skip_special_tokens=False)


def test_empty_table(make_df):
    assert wordbpe.encode_and_decode(make_df("doc_id long, text string", []), VOCABULARY).collect() == []


@pytest.mark.parametrize("ids", [[10**6], [-1], [1, None]])
def test_unknown_id_fails(make_df, ids):
    with pytest.raises(Exception, match="not in the vocabulary"):
        wordbpe.decode(make_df("ids array<int>", [{"ids": ids}]), VOCABULARY).collect()


def test_no_ids_decode_to_nothing(make_df):
    df = make_df("ids array<int>", [{"ids": None}, {"ids": []}, {"ids": [49407]}])
    assert [r["decoded"] for r in wordbpe.decode(df, VOCABULARY).collect()] == ["", "", "<|endoftext|>"]


def test_other_tokenizers_fail():
    with open(queries.WORDS_FILE, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["dropout"] = 0.1
    with pytest.raises(ValueError, match="not a tokenizer file"):
        wordbpe.Vocabulary(json.dumps(spec).encode())


def test_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 3)
    known = wordbpe.Remembered(VOCABULARY)
    for words in (["red", "green"], ["blue", "white", "black"], ["red", "x" * 100], ["green"]):
        known.learn(set(words))
        for w in words:
            assert known[w] == wordbpe.np.array(ids_of(library, w), "int32").tobytes()


def test_query(spark, library):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_wordbpe(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = ids_of(library, text or "")
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want
