"""Quality rules per document and per host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8


def _features(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    t = docs.select("doc_id", "source", text.alias("t"), F.transform(words, lambda w: F.xxhash64(w)).alias("wh"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE))
    no_space = F.translate("t", " \t\n\x0b\x0c\r", "")
    t = t.select(
        "doc_id", "source", "wh", F.size("wh").cast("long").alias("n_words"), F.length(no_space).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("wh") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    t = t.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("w"),
    )
    return t.select(*[c for c in t.columns if c != "w"], _covered("w").alias("n_repeat_words"))


def _covered(w: str) -> Column:
    """Words lying in a window whose hash occurs again: sort (hash, place), keep equal neighbours, sum their union."""

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            n = F.size(p)
            same = lambda k, d: F.coalesce(F.get(p, k + d)["h"] == F.get(p, k)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), n - 1), lambda k: same(k, F.lit(-1)) | same(k, F.lit(1)))
            return F.sort_array(F.transform(at, lambda k: F.get(p, k)["i"]))

        def union(starts: Column) -> Column:
            return F.aggregate(
                starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), s + WINDOW - acc["end"])).alias("n")),
                lambda acc: acc["n"],
            )

        # transform over a one-element array binds a value once
        return F.get(F.transform(F.transform(F.array(pairs), repeated), union), 0)

    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(count(F.col(w))).cast("long")


RULES = {
    "short": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > 10 and 10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}


def host_verdicts(features: DataFrame, max_rate: float = 0.8) -> DataFrame:
    """Per host and rule, the failure rate shrunk towards an empirical beta prior; a host fails if any exceeds ``max_rate``.

    The prior Beta(a, b) of a rule comes by moments from the hosts' own rates, weighted by their documents:
    mean m, variance v between hosts beyond what m(1-m)/n explains; a + b = m(1-m)/v - 1. A rule whose hosts do not
    differ beyond chance pools them (strength 10,000). Failure counts are sums (combined before the shuffle), so a
    hot host costs no more than another. Only two rows of moments (five numbers each) go through the driver.
    """
    fails = [F.sum(F.expr(f"cast({rule} as int)").cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = materialize(features.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), *fails), "hosts")
    n = F.col("host_docs")
    names = list(RULES)
    means = hosts.agg(F.sum("host_docs").alias("total"), F.count(F.lit(1)).alias("n_hosts"), F.sum(n.cast("double") * n).alias("n2"), *[(F.sum(f"f_{r}") / F.sum("host_docs")).alias(r) for r in names]).first()
    if not means["total"]:
        return hosts.select("source", "host_docs", *[F.lit(0.0).alias(f"host_{r}") for r in names], F.lit(False).alias("host_failed"))
    spread = hosts.agg(*[F.sum(n * (F.col(f"f_{r}") / n - F.lit(means[r])) ** 2).alias(r) for r in names]).first()
    scale = means["total"] - means["n2"] / means["total"]
    rates = {}
    for r in names:
        m = means[r]
        chance = m * (1 - m)
        v = (spread[r] - (means["n_hosts"] - 1) * chance) / scale if scale > 0 else 0.0
        strength = 10000.0 if v <= chance / 10000.0 else max(1.0, chance / v - 1)
        rates[r] = ((F.col(f"f_{r}") + F.lit(strength * m)) / (n + F.lit(strength))).alias(f"host_{r}")
    out = hosts.select("source", "host_docs", *rates.values())
    return out.withColumn("host_failed", F.greatest(*[f"host_{r}" for r in RULES]) > max_rate)


def quality_rules(docs: DataFrame, *, max_rate: float = 0.8) -> DataFrame:
    """Rules of each document, and the verdict of its host (``source``), joined back.

    docs: doc_id, text, source; other columns are ignored. A document is kept unless it fails the base rule (fewer
    than 20 words, or over 30 % of its words in repeated 8-word windows) or its host fails. Null and empty texts have
    no words and fail. A null source is a host of its own. Repeated rows each get a row; an empty table gives none.
    Host rates use every document. The narrow feature table is written once and read by both passes.
    """
    features = materialize(_features(docs), "features").withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repetitive']}"))
    verdicts = host_verdicts(features, max_rate).withColumnRenamed("source", "host")
    out = features.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    return out.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), *[F.round(f"host_{r}", 6).alias(f"host_{r}") for r in RULES],
    )
