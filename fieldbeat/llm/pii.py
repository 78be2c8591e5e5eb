"""Personal data: fixed patterns, and contexts learned from what they find.

What the patterns find are the seeds. The words before a seed are a lexical pattern. Patterns
and the identifiers they come with form a graph: a pattern is as good as its identifiers, an
identifier as good as its patterns, and a few rounds pass scores from one to the other. Unseen
identifiers behind a pattern with enough seeds are personal data, too, if seeds are a large
enough share of all identifiers behind it, or of those of the same form; they become seeds, which
may give more patterns, until nothing is added.

Only DataFrame functions; a regular expression's places come from the lengths of its matches
and of the gaps between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import pack, stage, unpack

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that only a context gives.
LEARNED = "context"

# The base patterns. Possessive, and tried only where a run starts or the last
# match ended, which finds the same matches without trying a long run again from its middle.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifiers that may be discovered: six or more characters with four or more digits.
IDENTIFIER = (
    r"(?<![^\s(\[\"':])(?=[A-Za-z0-9._/-]{6})(?=(?:[A-Za-z._/-]*+[0-9]){4})"
    r"[A-Za-z0-9][A-Za-z0-9._/-]*(?<![._/-])(?=[._/-]*+(?:[\s)\]\"',;:!?]|$))")
#: Words and characters of the context before an identifier.
CONTEXT_WORDS, CONTEXT_CHARS = 2, 64
#: Gaps that a context reaches over (so a list's items have the words before the list), and the
#: word that stands for the start of the text.
CONTEXT_GAPS, START = 32, "\ue000"
#: Distinct seeds a pattern needs, their least share of what is judged, of all identifiers behind it,
#: and of those in the form of a seed, and rounds of scoring.
SEEDS, SOUND, SHARE, LIKE_SHARE, ROUNDS = 5, 0.7, 0.4, 0.1, 3
#: Lengths are summed in blocks, so a text with n matches takes about n * (64 + n / 4096) steps.
BLOCK = 64


def _found(df: DataFrame, text: str, kind: str, pattern: str, possible: Column) -> DataFrame:
    """Adds ``kind``: every match with its start, end and the text before it (without other matches)."""
    m, g, steps, sums, before, tails = (
        f"_{kind}_{x}" for x in ("match", "gap", "step", "sum", "before", "tail"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def tail(gap: Column, i: Column) -> Column:
        first = F.concat(F.lit(f"{START} {START} "), gap)
        return F.right(F.when(i == 0, first).otherwise(gap), F.lit(CONTEXT_CHARS))

    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        gap = F.get(g, i)
        start = (
            F.get(before, block) + total(F.slice(steps, block * BLOCK + 1, i % BLOCK)) + F.length(gap))
        context = F.array_join(F.slice(
            tails, F.greatest(F.lit(1), i + 2 - CONTEXT_GAPS), F.least(i + 1, F.lit(CONTEXT_GAPS))), " ")
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"),
                        match.alias("value"), F.right(context, F.lit(CONTEXT_CHARS)).alias("before"))

    none = F.array().cast("array<string>")
    regex = F.lit(pattern)
    return (
        df.withColumn(m, F.when(possible, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none))
        .withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
        .withColumn(steps, F.zip_with(g, m, lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0))))
        .withColumn(sums, F.transform(
            F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")),
            lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK))))
        .withColumn(before, F.transform(
            F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b))))
        .withColumn(tails, F.transform(g, tail))
        .withColumn(kind, F.transform(m, span))
        .drop(m, g, steps, sums, before, tails)
    )


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), doubled)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: _holds(kind, span["value"])


def find_base(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds a list for each kind and ``unknown``, of (start, end, value, before): the base
    matches, and the identifiers outside of them. Existing columns of these names are replaced.

    Places are code points, ends exclusive. Null and empty texts have none.
    """
    text = "_text"
    df = df.withColumn(text, F.coalesce(column, F.lit("")))
    digit = F.col(text).rlike("[0-9]")
    possible = {"email": F.contains(F.col(text), F.lit("@")), "phone": F.contains(F.col(text), F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        df = _found(df, text, kind, pattern, possible.get(kind, digit))
        df = df.withColumn(kind, F.filter(kind, _check(kind)))
    df = _found(df, text, "unknown", IDENTIFIER, digit).drop(text)
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS])
    df = df.withColumn("_base", base).withColumn("unknown", F.filter(
        "unknown", lambda u: ~F.exists("_base", lambda b: (b["start"] < u["end"]) & (u["start"] < b["end"]))))
    return df.drop("_base")


def _pattern(before: Column) -> Column:
    """The last words before an identifier, in lower case, without numbers, addresses and marks;
    null if there are too few (the first may be cut off)."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(before), r"[\s(\[\"':,;]+", " "), " "),
        lambda w: w.rlike(rf"[\p{{L}}\p{{N}}{START}]") & ~w.rlike("@|[0-9].*[0-9]"))
    return F.when(F.size(words) > CONTEXT_WORDS, F.concat_ws(" ", F.slice(words, -CONTEXT_WORDS, CONTEXT_WORDS)))


def _failed(value: Column) -> Column:
    """Whether an identifier has the whole form of an address or a card but not what it checks."""
    address = value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$") & ~_holds("ip", value)
    digits = F.length(F.regexp_replace(value, "-", ""))
    card = value.rlike("^[0-9](?:-?[0-9])++$") & digits.between(16, 19) & ~_holds("card", value)
    return address | card


def _shape(value: Column) -> Column:
    """The form of an identifier: runs of digits and of letters, and what is between them."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")


def patterns(found: DataFrame) -> DataFrame:
    """(pattern, confidence, any_form, shapes): the patterns to trust, from the result of ``find_base``.

    Counted over distinct identifiers of a pattern, so copies of a text weigh as one. A pattern is
    sound if few of its identifiers fail a base check, or also stand behind contexts of mostly such
    ones. A sound pattern tells all identifiers behind it if its seeds have SHARE of them, and
    those of a form that its seeds have (``shapes``) if they have LIKE_SHARE of these. What it tells
    are seeds of the next round, until a round tells no more.
    """
    def pairs(column: Column) -> DataFrame:
        rows = found.select(F.explode(column).alias("s"))
        return rows.select(_pattern(F.col("s.before")).alias("pattern"), F.col("s.value").alias("value")
                           ).where(F.col("pattern").isNotNull()).distinct()

    # The shapes that identifiers may have, too, are few: one for each number of groups.
    shape = F.when(~F.col("value").rlike("[@+\\x20]"), _shape(F.col("value")))
    base = stage(pairs(F.concat(*[F.col(k) for k in KINDS])).groupBy("pattern").agg(
        F.count("*").alias("seeds"), F.collect_set(shape).alias("shapes")))
    every = stage(_judged(pairs(F.col("unknown")).withColumn("failed", _failed(F.col("value"))), base))
    seeds, unknown, told = base.select("pattern", "seeds"), every, None
    while True:
        trusted = stage(_trusted(seeds.where(F.col("seeds") >= SEEDS), unknown, base.select("pattern", "shapes")))
        now = split_join(every.where("against = 0"), trusted, "pattern").where(
            F.col("any_form") | F.array_contains("shapes", _shape(F.col("value")))).select("value").distinct()
        if told is not None:
            now = now.unionByName(told).distinct()
        now = stage(now)
        more = now.join(told, "value", "left_anti") if told is not None else now
        if more.isEmpty():
            return trusted
        told = now
        counts = split_join(every, told, "value").groupBy("pattern").agg(F.count("*").alias("more"))
        seeds = stage(base.join(counts, "pattern", "full").select("pattern", (
            F.coalesce("seeds", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("seeds")))
        unknown = every.join(told, "value", "left_anti").select(every.columns)


def _trusted(strong: DataFrame, every: DataFrame, shapes: DataFrame) -> DataFrame:
    """The patterns to trust among the strong ones."""
    unknown = stage(split_join(every, strong.select("pattern"), "pattern"))
    scored = unknown.withColumn("score", F.lit(0.0))
    strong = strong.join(shapes, "pattern", "left").withColumn("shapes", F.coalesce("shapes", F.array().cast("array<string>")))
    for _ in range(ROUNDS):
        rated = _rated(strong, scored).select("pattern", "confidence")
        # All patterns but the best speak for a value: one pattern does not confirm itself.
        doubt = F.log(1 - F.col("confidence"))
        of_value = split_join(unknown, rated, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(doubt) - F.min(doubt))).alias("score"))
        scored = stage(split_join(unknown, of_value, "value").select("pattern", "value", "against", "score"))
    rated = _rated(strong, scored)
    return rated.where((F.col("sound") >= SOUND) & ((F.col("confidence") >= SHARE) | (F.col("like_share") >= LIKE_SHARE))
                       ).select("pattern", "confidence", (F.col("confidence") >= SHARE).alias("any_form"), "shapes")


def _judged(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The identifiers of each context, with ``against``: 1 if they speak against it."""
    every = stage(pairs)
    failures = every.where("failed").groupBy("pattern").agg(F.count("*").alias("failures"))
    count = F.coalesce("seeds", F.lit(0))
    contrary = failures.where(F.col("failures") >= SEEDS).join(seeds, "pattern", "left").where(
        count / (count + F.col("failures") + 1) < 1 - SOUND).select("pattern")
    denied = split_join(every, contrary, "pattern").select("value").distinct().withColumn("denied", F.lit(True))
    return split_join(every, denied, "value", "left").select(
        "pattern", "value", (F.col("failed") | F.col("denied").isNotNull()).cast("int").alias("against"))


def _rated(strong: DataFrame, scored: DataFrame) -> DataFrame:
    """A pattern's confidence: the share of its identifiers that are seeds or that other patterns
    speak for, with one more against; the same among those of a form that its seeds have; and
    among those that something speaks for or against (``sound``)."""
    with_shapes = split_join(scored, strong.select("pattern", "shapes"), "pattern")
    open_ = 1 - F.col("score")
    like = F.array_contains("shapes", _shape(F.col("value"))).cast("int")
    sums = with_shapes.groupBy("pattern").agg(
        F.sum("score").alias("gain"), F.sum(F.col("against") * open_).alias("loss"),
        F.sum(open_).alias("open"), F.sum(like * open_).alias("like"))
    gain, loss, left, like_left = (F.coalesce(c, F.lit(0.0)) for c in ("gain", "loss", "open", "like"))
    good = F.col("seeds") + gain
    return strong.join(sums, "pattern", "left").select(
        "pattern", "shapes", (good / (good + left + 1)).alias("confidence"),
        (good / (good + like_left + 1)).alias("like_share"), (good / (good + loss + 1)).alias("sound"))


def find(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows without their text, with ``base`` and ``spans`` (kind, start, end): by kind, then
    start; ``spans`` has the learned ones at its end. Existing columns of these names are replaced.

    One row per input row, repeated rows included; null and empty texts have no spans.
    """
    kept = [c for c in df.columns if c not in (column, "base", "spans")]
    found = stage(
        find_base(pack(df.select(*kept, column), column), column).drop(column)
        .withColumn("row", F.monotonically_increasing_id()))
    trusted = patterns(found).select("pattern", "any_form", "shapes")
    seen = found.select("row", F.explode("unknown").alias("s")).select(
        "row", _pattern(F.col("s.before")).alias("pattern"), _shape(F.col("s.value")).alias("shape"),
        _span(LEARNED, F.col("s")).alias("span"))
    more = (
        split_join(seen.where(F.col("pattern").isNotNull()), trusted, "pattern")
        .where(F.col("any_form") | F.array_contains("shapes", F.col("shape"))).groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("more")))
    base = F.concat(*[_spans(k) for k in KINDS])
    joined = found.select("rest", "row", base.alias("base")).join(more, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return unpack(joined, kept, F.col("base"), spans.alias("spans"))


def _spans(kind: str) -> Column:
    return F.transform(kind, lambda s: _span(kind, s))


def _span(kind: str, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def joined(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
