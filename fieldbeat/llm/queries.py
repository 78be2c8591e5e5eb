"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm import (
    bpe,
    centroids,
    decontam,
    html,
    langid,
    negatives,
    pii,
    secrets,
    simhash,
    suffix,
    topk,
    urls,
    wordbpe,
)
from fieldbeat.llm.shared import stage

#: Production parameters.
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
TOP, QUERY_STEP = 5, 50
SIMHASH_WORDS, SIMHASH_BITS = 3, 2
CLUSTERS, ROUNDS, COMPONENTS, CENTROID_SCALE, SEED = 8, 10, 64, 1024, 3
ANCHOR_STEP, RELABEL_STEP, LABELS, POSITIVES, NEGATIVES, SHARE = 100, 7, 10, 5, 5, (80, 100)
URL_RULES = {
    "net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.quantized("embedding").alias("vector"))
    return topk.search(rows, F.col("key") % QUERY_STEP == 0, TOP)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS_FILE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its id: toxic, or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    mined = urls.mine(split_join(pages, labels, "page_id").select("url", "blocked"))
    return urls.judge(pages, URL_RULES, mined)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stage(simhash.fingerprints(docs, words=SIMHASH_WORDS).select("doc_id", "fingerprint"))
    groups = simhash.groups(prints, "doc_id", SIMHASH_BITS)
    return split_join(prints, groups, "fingerprint", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("lowest").alias("component_id"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.fit(pages)).drop("html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"),
        F.size("item_ids").cast("long").alias("n_items"), "item_ids", "coverage")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(secrets.find_base(docs).drop("text"))
    found = secrets.add_learned(found, secrets.learn(found))
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learnable(docs))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False))
    return langid.predict(docs.drop("lang"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_wordbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = wordbpe.read_vocabulary(WORDS_FILE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordbpe.encode_and_decode(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", centroids.quantized("embedding", CENTROID_SCALE, COMPONENTS).alias("vector"))
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("key").cast("string")), 256).asc_nulls_last()
    found = centroids.cluster(rows, CLUSTERS, ROUNDS, order)
    sums = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = spark.createDataFrame(  # a row for each of CLUSTERS centroids
        [(c, ",".join(map(str, x))) for c, x in enumerate(found.centroids)], "cluster int, joined string")
    return found.rows.join(F.broadcast(sums), "cluster").join(F.broadcast(digests), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia",
        sums.agg(F.sum("cluster_inertia")).scalar().alias("inertia"),
        F.sha2("joined", 256).alias("centroid_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", changed.otherwise(F.col("label")).alias("label"),
        topk.quantized("embedding").alias("vector"))
    return negatives.mine(rows, F.col("key") % ANCHOR_STEP == 0, POSITIVES, NEGATIVES, SHARE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_urls": op4_urls,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_suffix": op10_suffix,
    "op11_wordbpe": op11_wordbpe,
    "op12_centroids": op12_centroids,
    "op13_negatives": op13_negatives,
}

_FINITE = """embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0"""


def _centroids_sql() -> str:
    """All distances, in as many steps as there are rounds."""

    def nearest(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, v, c, d FROM (
                SELECT r, vec_id, v, c,
                    list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {COMPONENTS + 1})])::BIGINT AS d
                FROM v CROSS JOIN c{i})
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
            SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m
            FROM c{i} LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
                    SELECT c, i, sum(x) AS s, count(*) AS n
                    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)
                GROUP BY c) n ON n.c = c{i}.c)"""

    steps = ",\n        ".join(f"{nearest(i)},\n        {moved(i)}" for i in range(ROUNDS))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                [CAST(floor({CENTROID_SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE len(embedding) = {COMPONENTS} AND {_FINITE}),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v AS m
            FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v
                ORDER BY h NULLS LAST, v LIMIT {CLUSTERS})),
        {steps},
        {nearest(ROUNDS)}
        SELECT vec_id, c AS cluster, d AS distance,
            CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia,
            (SELECT sha256(array_to_string(m, ',')) FROM c{ROUNDS} WHERE c{ROUNDS}.c = a{ROUNDS}.c)
                AS centroid_sha256
        FROM a{ROUNDS}"""


ORACLE_SQL: dict[str, str] = {
    # All products; the other operators' methods have no usable form in SQL.
    "op1_topk": f"""
        WITH v AS (
            SELECT vec_id, min([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
            GROUP BY vec_id),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}""",
    "op12_centroids": _centroids_sql(),
    # All products of the anchors.
    "op13_negatives": f"""
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id,
                CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                CAST([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS DOUBLE[]) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
        scored AS (
            SELECT a.r AS a, a.vec_id AS anchor_id, o.vec_id, o.r, a.label = o.label AS same,
                CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
            FROM v a JOIN v o ON a.vec_id % {ANCHOR_STEP} = 0 AND a.r <> o.r),
        positive AS (
            SELECT a, anchor_id, vec_id AS positive_id, r AS p, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= {POSITIVES})
        SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank,
            s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM positive JOIN scored s USING (a, anchor_id)
        WHERE NOT s.same AND {SHARE[0]} * positive_score <= {SHARE[1]} * s.score AND s.score <= positive_score
        WINDOW best AS (PARTITION BY a, p ORDER BY s.score DESC, s.vec_id, s.r)
        QUALIFY row_number() OVER best <= {NEGATIVES}""",
}
