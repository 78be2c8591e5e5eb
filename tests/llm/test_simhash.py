"""Fingerprints and their groups against brute force."""

from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from fieldbeat.llm import graph, queries, simhash

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text, words=3):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [found[i : i + words] for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, order, bits):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    lowest = {}
    for i, o in enumerate(order):
        lowest[find(i)] = min(lowest.get(find(i), o), o)
    return [lowest[find(i)] for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprint():
    r = random.Random(1)
    texts = ["", " \t", "one", "One two", "É é x  y a A", "a b c d " * 500]
    texts += [" ".join(r.choice(["a", "B", "cc", "Ñ"]) for _ in range(r.randrange(30))) for _ in range(200)]
    for text in texts:
        assert simhash.fingerprint(text.encode(), 3) == signed(plain_fingerprint(text))


def near(seed, n):
    """Fingerprints in chains and clusters."""
    r, found = random.Random(seed), [0, (1 << 64) - 1]
    while len(found) < n:
        value = r.choice(found) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randrange(4)):
            value ^= 1 << r.randrange(64)
        found.append(value)
    return found


def test_groups(spark):
    prints = near(3, 600)
    order = list(range(len(prints)))
    random.Random(4).shuffle(order)
    df = spark.createDataFrame([(signed(p), o) for p, o in zip(prints, order, strict=True)], "fingerprint long, o long")
    got = {r["fingerprint"]: r["lowest"] for r in simhash.groups(df, "o", 2).collect()}
    for p, want in zip(prints, plain_groups(prints, order, 2), strict=True):
        assert got[signed(p)] == want


def test_groups_in_few_crowded_ranges(spark):
    """Thousands of fingerprints near one another: links grow with them, not with their square."""
    r = random.Random(5)
    prints = sorted({r.getrandbits(64) & 0x1FF | 7 << 40 for _ in range(3000)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fingerprint long, o long")
    links = simhash.links(df.select("fingerprint"), 2).count()
    assert links <= 2 * len(prints) * simhash.LEAST_RANGES
    assert {r["lowest"] for r in simhash.groups(df, "o", 2).collect()} == {0}


def test_chain_of_stars(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = graph.stars(edges).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(1, n)}
    assert graph.stars(edges.limit(0)).collect() == []


def test_odd_rows(make_df):
    schema = "doc_id long, text string, fingerprint string"
    texts = [None, "", " \n", "only", "a b c d e", "A B C D E", "z " * 40_000, None]
    df = make_df(schema, [{"doc_id": 9 - i, "text": t} for i, t in enumerate(texts)] + [{"text": "a b c d e"}])
    rows = simhash.fingerprints(df)
    got = {(r["doc_id"], r["fingerprint"]) for r in rows.select("doc_id", "fingerprint").collect()}
    assert got == {(9 - i, signed(plain_fingerprint(t))) for i, t in enumerate(texts)} | {
        (None, signed(plain_fingerprint("a b c d e")))}
    lowest = {r["fingerprint"]: r["lowest"] for r in simhash.groups(rows, "doc_id", 2).collect()}
    assert lowest[0] == 2 and lowest[signed(plain_fingerprint("a b c d e"))] == 4
    assert simhash.groups(rows.limit(0), "doc_id", 2).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(d["text"]) for d in docs]
    want = {(d["doc_id"], f"{p:016x}", g) for d, p, g in zip(
        docs, prints, plain_groups(prints, [d["doc_id"] for d in docs], 2), strict=True)}
    assert {tuple(r) for r in queries.op5_simhash(spark, SF_DIR).collect()} == want
