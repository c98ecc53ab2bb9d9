"""Prompts to recipe drafts: phrases found by an inverted index, the best cluster, its templates scored and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import prompts as p
from brindle.operators.ranking import ranked, top_per_group
from brindle.storage import materialize

GRAM = 4
FALLBACK = ("tourism", "tour_operators")


def _pieces(word: Column) -> Column:
    """All substrings of up to ``GRAM`` characters of a word."""
    at = F.sequence(F.lit(1), F.length(word))
    return F.flatten(F.transform(at, lambda i: F.array(*[F.substring(word, i, F.lit(n)) for n in range(1, GRAM + 1)])))


def _keys(word: Column) -> Column:
    """A word of up to ``GRAM`` characters itself, else its grams of that length."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - (GRAM - 1), F.lit(1)))
    return F.transform(at, lambda i: F.substring(word, i, F.lit(GRAM)))


def match_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows (text, phrases): the phrases (array, in order) that each distinct normalised ``text`` holds; texts without one are left out.

    A text holds a phrase that it contains anywhere, inside words too, or all of whose words are words of the text. Either way every
    piece of the phrase's words stands in the text, so each phrase is posted once, under the one of its grams which the fewest texts have;
    a text meets only the phrases posted under grams of its own, and those are verified. Texts travel as digests, and are joined
    once to the candidates of each. Null and empty texts and phrases match nothing; repeats count once.
    """
    texts = texts.select("text").where("text <> ''").distinct().withColumn("_digest", F.sha2("text", 256))
    phrases = phrases.select("phrase").where("phrase <> ''").distinct()
    grams = phrases.select("phrase", F.explode(F.array_distinct(F.flatten(F.transform(F.split("phrase", " "), _keys)))).alias("gram"))
    postings = texts.select("_digest", F.explode(F.array_distinct(F.flatten(F.transform(F.split("text", " "), _pieces)))).alias("gram"))
    postings = materialize(postings.join(grams.select("gram").distinct(), "gram", "left_semi"), "postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_texts"))
    rare = grams.join(counts, "gram", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    found = postings.join(rare.select("phrase", F.col("r.gram").alias("gram")), "gram").groupBy("_digest").agg(F.collect_set("phrase").alias("_found"))
    words = F.split("text", " ")
    held = F.filter("_found", lambda x: F.contains(F.col("text"), x) | p.is_subset(F.split(x, " "), words))
    return texts.join(found, "_digest").select("text", F.array_sort(held).alias("phrases")).where(F.size("phrases") > 0)


def rank_clusters(matched: DataFrame, hints: DataFrame) -> DataFrame:
    """Score of each cluster by text: 100 for each hint alias that the text holds, plus the longest one's length.
    ``hints`` has vertical, cluster, alias, phrase (the alias normalised); aliases of one phrase count each."""
    held = matched.select("text", F.explode("phrases").alias("phrase")).join(hints.where("alias is not null"), "phrase")
    return held.groupBy("text", "cluster").agg(F.min("vertical").alias("vertical"), (F.count(F.lit(1)) * 100 + F.max(F.length("alias"))).cast("int").alias("score"))


def prompt_texts(asks: DataFrame) -> DataFrame:
    """(prompt, text): each distinct prompt and its normalised text. Normalising costs far more than moving a row, so it is done once a
    prompt, however many rows ask it; null prompts are left out."""
    known = materialize(asks.select("prompt").where("prompt is not null").distinct(), "asked")
    return materialize(known.select("prompt", p.normalize_prompt(F.col("prompt")).alias("text")), "prompts")


def with_drafts(asks: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``asks`` (prompt_id, prompt) with the drafts ``found`` (text and any columns) for the texts ``named`` by :func:`prompt_texts`."""
    return asks.select("prompt_id", "prompt").join(named, "prompt").join(found, "text").drop("text")


def draft_variants(asks: DataFrame, hints: DataFrame, templates: DataFrame, k: int = 6, fallback: tuple[str, str] = FALLBACK) -> DataFrame:
    """The first ``k`` drafts of each prompt, best first, by all rules of scoring (:func:`text_drafts`).

    ``asks``: prompt_id, prompt. Prompts that are null or hold no word give no draft; equal prompts are scored once, and each row of ``asks`` gets its drafts.
    """
    named = prompt_texts(asks)
    return with_drafts(asks, named, text_drafts(named, hints, templates, k, fallback))


def text_drafts(texts: DataFrame, hints: DataFrame, templates: DataFrame, k: int = 6, fallback: tuple[str, str] = FALLBACK) -> DataFrame:
    """The first ``k`` drafts of each distinct ``text`` (normalised), best first; empty texts have none.

    ``hints``: vertical, cluster, alias. ``templates``: template_key (one row each within a cluster; of more the first
    by label stays), label, vertical, cluster, sub_intent, strategy (browser, website, hybrid or map), aliases, search_terms, website_keywords,
    language_hints (arrays) and priority. A prompt's cluster is its best by :func:`rank_clusters`, ties by name, ``fallback`` if it holds no
    alias. A template scores its priority, 10 for each alias held, 6 for its sub-intent, 5 for a place in the prompt, and the bonus of its
    strategy; order is by score, sub-intent, label, key. A cluster without templates gives one broad draft.

    Templates without a hit differ between prompts of a cluster only in their strategy's bonus, which has four cases. They are ordered once for each
    case, and a prompt with m hits reads the first k + m of its case, so no prompt meets the whole cluster.
    """
    texts = materialize(texts.select("text").where("text <> ''").distinct(), "texts")
    templates = top_per_group(templates, ["cluster", "template_key"], [F.col("label")])
    hints = hints.select("vertical", "cluster", "alias", p.normalize_prompt(F.col("alias")).alias("phrase"))
    intent = p.normalize_prompt(F.replace(F.col("sub_intent"), F.lit("-"), F.lit(" ")))
    terms = templates.select("cluster", "template_key", F.posexplode("aliases").alias("pos", "alias")).withColumn("phrase", p.normalize_prompt(F.col("alias")))
    terms = terms.unionByName(templates.select("cluster", "template_key", F.lit(-1).alias("pos"), F.col("sub_intent").alias("alias"), intent.alias("phrase")))
    matched = materialize(match_phrases(texts, hints.select("phrase").unionByName(terms.select("phrase"))), "matched")
    best = top_per_group(rank_clusters(matched, hints), ["text"], [F.desc("score"), F.col("cluster")])
    chosen = texts.join(best, "text", "left").join(matched, "text", "left").select(
        "text", F.coalesce("vertical", F.lit(fallback[0])).alias("vertical"), F.coalesce("cluster", F.lit(fallback[1])).alias("cluster"), F.coalesce("score", F.lit(0)).alias("cluster_score"), "phrases",
        p.has_any(F.col("text"), p.BROWSER_WORDS).alias("browsing"), p.has_any(F.col("text"), p.WEBSITE_WORDS).alias("own_site"),
    )
    chosen = materialize(chosen, "chosen")
    held = chosen.select("text", "cluster", F.explode("phrases").alias("phrase")).join(terms, ["cluster", "phrase"]).groupBy("text", "template_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "alias")))).alias("hits"), F.max(F.col("pos") < 0).alias("named")
    )
    held = materialize(held, "held")
    cases = templates.select("cluster", "template_key", "sub_intent", "label", "priority", "strategy", F.explode(F.array(*[F.struct(F.lit(b).alias("browsing"), F.lit(w).alias("own_site")) for b in (False, True) for w in (False, True)])).alias("x"))
    cases = cases.select("*", "x.*").withColumn("base", F.col("priority") + p.bonus(F.col("strategy"), F.col("browsing"), F.col("own_site")))
    case = ["cluster", "browsing", "own_site"]
    cases = ranked(cases, case, [F.desc("base"), F.col("sub_intent"), F.col("label"), F.col("template_key")], "place").select(*case, "place", "template_key")
    reads = chosen.join(held.groupBy("text").agg(F.count(F.lit(1)).cast("int").alias("m")), "text", "left")
    reads = reads.select("text", *case, F.explode(F.sequence(F.lit(1), F.lit(k) + F.coalesce("m", F.lit(0)))).alias("place")).join(cases, [*case, "place"])
    nothing = F.lit(None).cast(held.schema["hits"].dataType)
    pairs = held.unionByName(reads.select("text", "template_key", nothing.alias("hits"), F.lit(False).alias("named")))
    pairs = pairs.groupBy("text", "template_key").agg(F.coalesce(F.max("hits"), F.array().cast(held.schema["hits"].dataType)).alias("hits"), F.max("named").alias("named"))
    rows = pairs.join(chosen.drop("phrases", "vertical"), "text").join(templates, ["cluster", "template_key"]).withColumn("place", p.location_hint(F.col("text")))
    extra = p.bonus(F.col("strategy"), F.col("browsing"), F.col("own_site"))
    rows = rows.withColumn("match_score", (10 * F.size("hits") + F.when(F.col("named"), 6).otherwise(0) + F.when(F.col("place").isNotNull(), 5).otherwise(0) + extra).cast("int"))
    rows = rows.withColumn("fit_score", (F.col("priority") + F.col("match_score")).cast("int"))
    order = [F.desc("fit_score"), F.col("sub_intent"), F.col("label"), F.col("template_key")]
    drafts = ranked(top_per_group(rows, ["text"], order, k), ["text"], order).select("text", "rank", "template_key", "cluster", "cluster_score", "vertical", "label", "sub_intent", "strategy", F.col("priority").cast("int").alias("template_score"), "match_score", "fit_score", *_proposal())
    broad = chosen.join(templates.select("cluster").distinct(), "cluster", "left_anti").select(*_broad())
    return drafts.unionByName(broad)


def _proposal() -> list[Column]:
    """Slug, terms, languages and reasons of a scored template."""
    place, terms = F.col("place"), F.coalesce("search_terms", F.array().cast("array<string>"))
    local = F.when(place.isNotNull(), F.transform(F.slice(terms, 1, 3), lambda t: F.concat(t, F.lit(" "), place))).otherwise(F.array().cast("array<string>"))
    search = F.slice(F.array_distinct(F.concat(local, terms)), 1, 8)
    known = F.coalesce("website_keywords", F.array().cast("array<string>"))
    names = F.transform("hits", lambda h: h["alias"])
    strategy = F.when((F.col("strategy") == "browser") & F.col("browsing"), p.REASONS["browser"]).when((F.col("strategy") == "website") & F.col("own_site"), p.REASONS["website"]).when(F.col("strategy") == "hybrid", p.REASONS["hybrid"])
    reasons = F.array(
        F.when(F.col("named"), F.format_string("Prompt directly references the '%s' sub-intent.", "sub_intent")),
        F.when(F.size("hits") > 0, F.concat(F.lit("Matches intent terms: "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("."))).otherwise("Added as a closely related variant inside the selected cluster."),
        F.when(place.isNotNull(), F.concat(F.lit("Localized search terms for "), place, F.lit("."))), strategy,
    )
    languages = F.when(F.size("language_hints") > 0, F.array_distinct("language_hints")).otherwise(p.language_hints(F.col("text")))
    return [
        p.slugify(F.concat_ws(" ", "template_key", place)).alias("slug"), search.alias("search_terms"), F.slice(F.array_distinct(F.concat(known, search)), 1, 10).alias("website_keywords"),
        languages.alias("language_hints"), F.array_compact(reasons).alias("fit_reasons"),
    ]


def _broad() -> list[Column]:
    """The one draft of a text whose cluster has no templates."""
    slug, label = p.slugify(F.col("text")), F.initcap(F.array_join(F.slice(F.split("text", " "), 1, 8), " "))
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return [
        F.col("text"), F.lit(1).alias("rank"), slug.alias("template_key"), F.col("cluster"), F.col("cluster_score"), F.col("vertical"), label.alias("label"), F.lit("broad-intent").alias("sub_intent"), F.lit("hybrid").alias("strategy"),
        F.lit(50).alias("template_score"), F.lit(0).alias("match_score"), F.lit(50).alias("fit_score"), slug.alias("slug"), F.array("text").alias("search_terms"), texts("contact", "about", "booking").alias("website_keywords"),
        p.language_hints(F.col("text")).alias("language_hints"), texts("Fallback draft generated because no curated variants exist for this cluster yet.").alias("fit_reasons"),
    ]
