"""Personal data against plain regular expressions, and discovery from contexts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldbeat.llm import pii, queries

SF_DIR = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(d) for d in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return ",".join(
        f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "") if holds(kind, m[0]))


def found(df):
    rows = pii.find(df).select("doc_id", pii.joined("base").alias("b"), pii.joined("spans").alias("s"))
    return {r["doc_id"]: (r["b"], r["s"]) for r in rows.collect()}


def test_base_spans(spark):
    r = random.Random(5)
    bits = ["a", "1", ".", "@", "-", "+", " ", "255", "256", "00", "b.c", "_", "é", "😀", "(", ")", "0",
            "4539 1488 0343 6467", "4539148803436467", "1.2.3.4", "a@b.co", "+1 (555) 010-9999"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(1500)]
    texts += ["", None, "a@b.c " * 300, "1" * 3000, "x" * 20_000, "1." * 2000, "+1" + "." * 5000, "a.b-" * 4000 + "@c.d"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {i: b for i, (b, _) in got.items()} == {i: plain(t) for i, t in enumerate(texts)}


def test_unseen_identifiers_of_a_known_context(spark):
    """Cards stand behind one phrase; other numbers behind it are found, elsewhere they are not."""
    cards = ["4539148803436467", "4485275742308327", "4916338506082832", "4556737586899855",
             "4532015112830366", "4024007103939509"]
    texts = [f"text {i}. her account number is {c} as said" for i, c in enumerate(cards)]
    texts += ["his account number is 88-1234-77 today", "born in about year 1999-2003-04 they say",
              "account number is", None]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    start = texts[6].index("88-")
    assert got[6] == ("", f"context:{start}:{start + 10}")
    assert all(b == s == plain(texts[i]) for i, (b, s) in got.items() if i != 6)


def luhn_cards(n):
    """Distinct card numbers that pass the check."""
    bodies = (f"{4000 + i}{i * 7919 % 10**11:011d}" for i in range(n))
    return [next(c for d in range(10) if holds("card", c := f"{b}{d}")) for b in bodies]


def test_as_many_unseen_identifiers_as_seeds(spark):
    """They are unknown, not evidence against their context; numbers that fail a check are."""
    cards = luhn_cards(40)
    texts = [f"text {i}. her account number is {c} as said" for i, c in enumerate(cards)]
    texts += [f"his account number is K{i}-{7000 + i} today" for i in range(40)]
    first = len(texts)
    wrong = [f"{c[:-1]}{(int(c[-1]) + 1) % 10}" for c in luhn_cards(50)[40:]]
    texts += [f"they wrote down the total of {c} again" for c in [*luhn_cards(56)[50:], *wrong]]
    texts += ["they wrote down the total of X1234-5 again"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(got[i][1].startswith("context:") for i in range(40, 80))
    assert all(got[i][0] == got[i][1] for i in range(first, len(texts)))


@pytest.mark.parametrize("n", [200, 5000])
def test_dates_behind_a_phrase_with_few_seeds(spark, n):
    """Not one is marked, also where the phrase stands before phone numbers now and then."""
    texts = [f"we call the desk at +49 30 {1234567 + i}" for i in range(6)]
    texts += [f"we open the desk at {2000 + i // 300}-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}" for i in range(n)]
    texts += [f"their card number is {c} now" for c in luhn_cards(9)]
    texts += [f"the version number is {i}.{i % 7}.{1000 + i} now" for i in range(n)]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(b == s for b, s in got.values())


def test_unseen_cards_among_many_numbers(spark):
    """Of a form that the seeds have, identifiers are found beside many of another form."""
    known = luhn_cards(1000)
    unseen = [f"{c[:4]}-{c[4:8]}-{c[8:15]}" for c in luhn_cards(1500)[1000:]]      # too short to be a card
    dashed = [f"{c[:4]}-{c[4:8]}-{c[8:]}" for c in luhn_cards(1800)[1500:]]
    texts = [f"the account number is {c} as said" for c in [*known, *unseen, *dashed]]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(got[i][1].startswith("context:") for i in range(1000, 1500)) >= 450
    texts += [f"the account number is v{i}.{i % 10}.{i % 7} of it" for i in range(6000)]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(got[i][1].startswith("context:") for i in range(1000, 1500)) >= 450
    assert all(got[i] == ("", "") for i in range(1800, len(texts)))


def test_contexts_at_text_starts_and_in_lists(spark):
    cards = luhn_cards(30)
    texts = [f"account number {c}" for c in cards[:10]] + ["account number K12-3456"]
    texts += [f"card no {a} card no {b}" for a, b in zip(cards[10:16:2], cards[11:16:2])]
    texts += ["his card no R77-8899 card no S12-9988", f"we keep on file {', '.join(cards[16:24])}", "we keep on file T12-3456, U65-4321"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for i, values in ((10, ["K12-3456"]), (14, ["R77-8899", "S12-9988"]), (16, ["T12-3456", "U65-4321"])):
        starts = [texts[i].index(v) for v in values]
        assert got[i][1] == ",".join(f"context:{s}:{s + 8}" for s in starts)


def test_what_is_found_gives_more_contexts(spark):
    """Members stand behind the phrase of the cards, too; only their other phrases lead further."""
    members, staff = ([f"{c}{i}-{4000 + i}" for i in range(6)] for c in "MS")
    texts = [f"text {i}. her account number is {c} as said" for i, c in enumerate(luhn_cards(6))]
    texts += [f"his account number is {w} today" for w in members]
    texts += [f"a badge belongs to member {w} they say" for w in [*members, *staff]]
    texts += [f"the door was opened for {w} at night" for w in [*staff, "Z9-8765"]]
    texts += ["parcel from the store of Q4-4321 in town"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(got[i][1].startswith("context:") for i in range(6, len(texts) - 1))
    assert got[len(texts) - 1] == ("", "")


def test_copies_of_one_text_teach_nothing(spark):
    texts = ["her account number is 4539148803436467 as said"] * 50 + ["his account number is 88-1234-77 today"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got[50] == ("", "")


def test_odd_rows(make_df):
    schema = "doc_id long, text string, base int, spans string, email string, unknown int, row int"
    assert found(make_df(schema, [])) == {}
    df = make_df(schema, [{"text": "x@y.z", "email": "own", "row": 4}, {"text": "x@y.z"}, {"doc_id": 1}])
    rows = pii.find(df).collect()
    assert pii.find(df).columns == ["doc_id", "email", "unknown", "row", "base", "spans"]
    assert sorted((str(r["email"]), r["row"] or 0, len(r["base"])) for r in rows) == [
        ("None", 0, 0), ("None", 0, 1), ("own", 4, 1)]


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pii.find_base(docs.select("doc_id", "text")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 5000])
def test_many_matches(spark, n):
    text = "ab 1.2.3.4\n" * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find_base(df).select(F.size("ip")).first()[0] == n
    assert found(df)[1][0] == plain(text)


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op3_pii(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        base = plain(text)
        row = rows[doc_id]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [base.count(f"{k}:") for k in PLAIN]
        assert row["spans"].startswith(base)
