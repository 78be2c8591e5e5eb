"""Tiling and contaminated documents against brute force."""

from __future__ import annotations

import random
import re

from fieldbeat.llm import decontam, queries

SF_DIR = "/root/testdata/sf0.001"


def plain_tiles(item, text, least):
    """Marks the longest free match again and again, trying all pairs of places."""
    used_item, used_text, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                       and text[j + n] is not None and i + n not in used_item and j + n not in used_text):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return found
        found.append(best)
        used_item |= set(range(best[1], best[1] + best[0]))
        used_text |= set(range(best[2], best[2] + best[0]))


def plain_coverage(item, text):
    return sum(t[0] for t in plain_tiles(item, text, min(5, len(item)))) / len(item) if item else 0.0


def test_tiles():
    r = random.Random(1)
    for _ in range(400):
        item = [r.choice("abcdef") for _ in range(r.randrange(1, 25))]
        text = [r.choice("abcdef") for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):  # passages of the item, in any order
            a = r.randrange(len(item))
            text += [*item[a : a + r.randrange(1, 15)], None][: r.choice([None, -1])]
        least = r.randrange(1, 6)
        got, want = decontam.tiles(item, text, least), plain_tiles(item, text, least)
        assert sorted(t[0] for t in got) == sorted(t[0] for t in want)
        assert all(item[i : i + n] == text[j : j + n] for n, i, j in got)
        marks = [k for n, _, j in got for k in range(j, j + n)]
        assert len(marks) == len(set(marks))


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def planted():
    """Benchmark items, and documents with whole, reordered, partial and no passages of them."""
    r = random.Random(2)
    items = [words(r, r.randrange(20, 40)) for _ in range(12)] + [["two", "words"], words(r, 5)]
    docs = []
    for k in range(90):
        item, text = items[k % 12], words(r, r.randrange(5, 60))
        kind = k % 6
        if kind == 0:
            text[3:3] = item
        elif kind == 1:  # passages in another order
            cut = len(item) // 2
            text = [*text[:2], *item[cut:], *text[2:], *item[:cut]]
        elif kind == 2:  # far too little
            text += item[:7]
        elif kind == 3:
            text += [x for a in range(0, len(item), 3) for x in (*item[a : a + 3], "no")]
        elif kind == 4:
            text[1:1] = items[12 + k % 2]
        docs.append(text)
    return items, docs


def test_contaminated(spark):
    items, docs = planted()
    benchmark = spark.createDataFrame([(100 + i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, ", ".join(t).upper()) for i, t in enumerate(docs)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.contaminated(df, benchmark).collect()}
    hits = 0
    for i, text in enumerate(docs):
        cover = {100 + k: plain_coverage(item, text) for k, item in enumerate(items)}
        want = sorted(k for k, c in cover.items() if c >= decontam.COVERAGE)
        assert rows[i]["item_ids"] == want
        assert rows[i]["coverage"] == (max(cover.values()) if want else None)
        hits += bool(want)
    assert 40 <= hits < 60


def test_odd_rows(make_df):
    schema = "doc_id long, text string, seeds int, runs int, row int, coverage string"
    passage = "one two three four five six seven"
    df = make_df(schema, [{"doc_id": 1}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": passage, "row": 7},
                          {"doc_id": 3, "text": passage}, {"text": f"x {passage.title()}! y"},
                          {"doc_id": 4, "text": "one two three four five"}, {"doc_id": 5, "text": f"{passage} " * 20_000}])
    benchmark = make_df("item_id long, text string, key string", [
        {"item_id": 8, "text": passage}, {"item_id": 8, "text": passage}, {"item_id": 9}, {"text": passage},
        {"item_id": 7, "text": " ."}])
    found = decontam.contaminated(df, benchmark)
    assert found.columns == ["doc_id", "text", "seeds", "runs", "row", "item_ids", "coverage"]
    got = {(r["doc_id"], r["row"]): (r["item_ids"], r["coverage"]) for r in found.drop("text").collect()}
    hit, clean = ([8], 1.0), ([], None)
    assert got == {(1, None): clean, (2, None): clean, (3, 7): hit, (3, None): hit, (None, None): hit,
                   (4, None): clean, (5, None): hit}
    assert decontam.contaminated(df.limit(0), benchmark).count() == 0
    clean = decontam.contaminated(df, benchmark.limit(0))
    assert clean.where("coverage IS NOT NULL").count() == 0 and clean.count() == 7


def test_query(spark):
    def split(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op7_decontamination(spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        t = split(text)
        runs = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        near = {k: w for k, w in items.items() if any(tuple(w[i : i + 5]) in runs for i in range(len(w) - 4))}
        want = sorted(k for k, w in near.items() if plain_coverage(w, t) >= decontam.COVERAGE)
        row = rows[doc_id]
        assert (row["item_ids"], row["n_items"], row["contaminated"]) == (want, len(want), bool(want))
