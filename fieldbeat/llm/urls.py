"""URL filters: fixed rules, and association rules mined from labelled URLs.

A labelled URL is a set of tokens (host labels, path segments, query names) and its label.
FP-growth finds the token sets that come with the label ``block`` often enough; those with
enough confidence are rules. Each rule is indexed by its rarest token, so a URL meets only the
rules that it may fulfil, and fulfils one if it has all its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import stage

#: Part of the labelled URLs that hold a rule's tokens and the label; of those with the tokens.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Fewer rows than this show nothing, however small the table.
LEAST_ROWS = 20
BLOCK, ALLOW = "block", "allow"
_LABEL = "label:block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty if the url is null or has no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit(""))


def tokens(url: str) -> Column:
    """Distinct tokens: host labels, path segments (digits as ``#``) and query names."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)

    def parts(text: Column, pattern: str, mark: str) -> Column:
        found = F.filter(F.split(text, pattern), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(F.concat(
        parts(host(url), r"\.", "host:"),
        parts(F.regexp_replace(path(url), "[0-9]+", "#"), "/", "path:"),
        parts(F.regexp_replace(query, "=[^&]*", ""), "&", "query:"),
    ))


def rule_of(rules: dict[str, str], host: str, path: str) -> Column:
    """The longest fixed rule that fits, else null. A rule is a host and a path; it fits that
    host and its subdomains, if the path starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the last one wins
        domain, slash, start = rule.partition("/")
        fits = (F.col(host) == domain) | F.col(host).endswith(f".{domain}")
        found = F.when(fits & F.col(path).startswith(slash + start), F.lit(rule)).otherwise(found)
    return found


def mine(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> DataFrame:
    """(tokens, confidence, key): rules that block, mined from all rows with a boolean label.

    ``key`` is the rule's rarest token, the first in order on a tie. Rows with a null label are
    left out; with fewer than LEAST_ROWS blocked rows there are no rules.
    """
    known = labelled.where(F.col(blocked).isNotNull() & F.col(url).isNotNull())
    baskets = stage(known.select(
        F.concat(tokens(url), F.when(F.col(blocked), F.array(F.lit(_LABEL))).otherwise(F.array()))
        .alias("items")))
    spark = labelled.sparkSession
    n, blocked_rows = baskets.agg(
        F.count("*"), F.count_if(F.array_contains("items", _LABEL))).first()
    if blocked_rows < LEAST_ROWS:
        return spark.createDataFrame([], "tokens array<string>, confidence double, key string")
    support = max(SUPPORT, LEAST_ROWS / n)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", _LABEL)).select(
        F.monotonically_increasing_id().alias("rule"), F.col("antecedent").alias("tokens"), "confidence")
    rules = stage(rules)
    counts = model.freqItemsets.where("size(items) = 1").select(
        F.col("items")[0].alias("token"), "freq")
    keys = (
        rules.select("rule", F.explode("tokens").alias("token")).join(counts, "token")
        .groupBy("rule").agg(F.min(F.struct("freq", "token"))["token"].alias("key")))
    return stage(rules.join(keys, "rule").select("tokens", "confidence", "key"))


def match(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence): the distinct urls that fulfil a rule, with their best rule's confidence."""
    distinct = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct()
    owned = distinct.withColumn("owned", tokens("url"))
    met = split_join(owned.select("url", "owned", F.explode("owned").alias("key")), rules, "key")
    fulfilled = met.where(F.size(F.array_except("tokens", "owned")) == 0)
    return fulfilled.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, fixed: dict[str, str], mined: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the fixed rule, else null) and ``verdict``: the fixed
    rule's, else ``block`` where a mined rule is fulfilled, else ``allow``.

    Existing columns of these names are replaced; repeated rows and null urls stay.
    """
    told = pages.withColumn("host", host(url)).withColumn("path", path(url))
    told = told.withColumn("rule", rule_of(fixed, "host", "path"))
    blocked = match(told, mined, url).select(F.col("url").alias(url), F.lit(BLOCK).alias("verdict"))
    verdict = F.lit(None).cast("string")
    for rule, says in fixed.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    joined = split_join(told.drop("verdict"), blocked, url, "left")
    return joined.withColumn("verdict", F.coalesce(verdict, F.col("verdict"), F.lit(ALLOW)))
