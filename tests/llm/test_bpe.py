"""Encoding against the tiktoken library, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fieldbeat.llm import bpe, queries

SF_DIR = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(queries.RANKS_FILE)


def encoding(pattern):
    return tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=bpe.Vocabulary(RANKS).ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference():
    return encoding(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def whole():
    """Takes any text as one piece."""
    return encoding(r"(?s:.+)")


def coded(df):
    """Both ways at once, and one after the other."""
    once = bpe.encode_and_decode(df, RANKS, public_tokenizers.PATTERN)
    apart = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert once.columns == [c for c in apart.columns if c != "text"]
    assert once.exceptAll(apart.select(*once.columns)).isEmpty()
    return apart


def test_pieces_of_every_kind(whole):
    vocabulary, r = bpe.Vocabulary(RANKS), random.Random(1)
    for _ in range(2000):
        n = r.randrange(1, 40)
        text = "".join(r.choice("aab") if r.random() < 0.9 else chr(r.randrange(33, 0x2FFF)) for _ in range(n))
        assert list(vocabulary.encode(text.encode())) == whole.encode_ordinary(text)


def test_equal_ranks_go_from_left_to_right(whole):
    vocabulary = bpe.Vocabulary(RANKS)
    for piece in ("a" * 999, "ab" * 500, "aaab" * 77, "=" * 1001):
        assert list(vocabulary.encode(piece.encode())) == whole.encode_ordinary(piece)


def test_many_pieces_at_once(whole):
    """In one queue, whichever way it is worked off."""
    vocabulary, r = bpe.Vocabulary(RANKS), random.Random(5)
    alphabet = "etaoinshrdlucmfw ,.ABC019=-"
    pieces = ["".join(r.choice("aab") if r.random() < 0.4 else r.choice(alphabet) if r.random() < 0.9
                      else chr(r.randrange(33, 0x2FFF)) for _ in range(r.randrange(1, 40))) for _ in range(6000)]
    pieces += ["a" * 999, "ab" * 5000, "aaab" * 777, "=" * 1001, "", "the", "x" * 30_001]
    want = [whole.encode_ordinary(p) for p in pieces]
    assert sum(map(len, pieces)) > bpe.MANY_BYTES
    assert vocabulary.encode_all([p.encode() for p in pieces]) == want
    for run in (vocabulary._merged, vocabulary._merged_together):
        some = [(p.encode(), w) for p, w in zip(pieces, want) if p]
        assert run([p for p, _ in some]) == [w for _, w in some]


def test_a_rank_that_lets_a_lower_one_wait():
    """Merging b and c lets a, bc merge before the next b and c of the piece, which it overlaps."""
    tokens = [bytes([b]) for b in range(256)] + [b"abcb", b"bc", b"abc", b"cb"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    vocabulary = bpe.Vocabulary(lines)
    reference = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=vocabulary.ranks, special_tokens={})
    r = random.Random(2)
    pieces = ["".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    want = [reference.encode_ordinary(p) for p in pieces]
    some = [(p.encode(), w) for p, w in zip(pieces, want) if p.encode() not in vocabulary.ranks]
    for run in (vocabulary._merged, vocabulary._merged_together):
        assert run([p for p, _ in some]) == [w for _, w in some]


def test_very_long_piece():
    vocabulary = bpe.Vocabulary(RANKS)
    piece = "".join(random.Random(2).choice("abcdefgh") for _ in range(200_000)).encode()
    assert b"".join(vocabulary.tokens[i] for i in vocabulary.encode(piece)) == piece


def test_odd_rows(make_df, reference):
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "né 😀 東京", "x" * 30_000 + " y", "b", "b"]
    df = make_df("doc_id long, text string, ids string, decoded int",
                 [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r for r in coded(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == reference.encode_ordinary(text or "")
        assert bytes(rows[i]["decoded"]) == (text or "").encode()


def test_empty_table(make_df):
    assert coded(make_df("doc_id long, text string", [])).collect() == []


def test_unknown_id_fails(make_df):
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(make_df("ids array<int>", [{"ids": [10**6]}]), RANKS).collect()


def test_query(spark, reference):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = reference.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want
