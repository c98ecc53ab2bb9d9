"""Prompt text, slugs and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substring replacements, then words that carry nothing.
REPLACEMENTS = (
    ("rent a car", "car rental"), ("car hire", "car rental"), ("motorbike hire", "motorbike rental"), ("motorcycle hire", "motorbike rental"), ("bike hire", "bike rental"),
    ("quad bike", "quad"), ("atv", "quad"), ("haircut", "hair"), ("hairstylist", "hair"), ("nails", "nail"), ("manicure", "nail"), ("pedicure", "nail"), ("eyelashes", "lash"),
    ("eyebrow", "brow"), ("wellness", "spa"), ("scuba", "diving"), ("lawyer", "law"), ("attorney", "law"), ("course", "training"), ("academy", "training"),
    ("estate agent", "property agency"), ("real estate", "property"),
)
STOP_WORDS = ("a", "an", "and", "best", "business", "businesses", "complete", "company", "companies", "experience", "for", "full", "in", "local", "of", "service", "services", "the", "with")


# Fixed values.
PLACES = ("thailand", "phuket", "chiang mai", "pattaya", "samui", "bangkok", "bali", "berlin", "paris")
LANGUAGES = ((("thailand", "thai", "phuket", "chiang mai", "pattaya", "samui", "bangkok"), ("en", "th")), (("germany", "berlin", "munich"), ("en", "de")), (("france", "paris"), ("en", "fr")))
BROWSER_WORDS = ("experience", "luxury", "sanctuary", "wellness", "activity")
WEBSITE_WORDS = ("service", "agency", "firm", "clinic", "studio")
REASONS = {
    "browser": "Prompt hints that richer browser-assisted discovery may pay off.", "website": "Prompt leans toward businesses that are better differentiated on their own websites.",
    "hybrid": "Hybrid discovery keeps both map signals and website verification in play.",
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def location_hint(text: Column) -> Column:
    """What follows the last ``in`` up to the end, else the first known place in the text."""
    tail = F.btrim(F.regexp_extract(text, r"\bin ([a-z][a-z\s-]+)$", 1))
    return F.coalesce(F.when(tail != "", tail), *[F.when(text.contains(p), p) for p in PLACES])


def language_hints(text: Column) -> Column:
    out = None
    for words, langs in LANGUAGES:
        out = (F.when if out is None else out.when)(has_any(text, words), F.array(*[F.lit(x) for x in langs]))
    return out.otherwise(F.array(F.lit("en")))


def bonus(strategy: Column, browsing: Column, own_site: Column) -> Column:
    """Points of a strategy; the flags say whether the prompt holds a word that speaks for browsing or for the firm's own site."""
    return F.when(strategy == "browser", F.when(browsing, 4).otherwise(1)).when(strategy == "website", F.when(own_site, 3).otherwise(1)).when(strategy == "hybrid", 2).otherwise(0)


def strategy_bonus(strategy: Column, text: Column) -> Column:
    return bonus(strategy, has_any(text, BROWSER_WORDS), has_any(text, WEBSITE_WORDS))


def normalize_prompt(prompt: Column) -> Column:
    """Lower case, plain words, ordered replacements (cascading, inside words too), no stop words, simple singulars."""
    t = F.lower(F.btrim(prompt))
    t = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" ")), F.lit("-"), F.lit(" "))
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))
    for source, target in REPLACEMENTS:
        t = F.replace(t, F.lit(source), F.lit(target))
    words = F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))

    def singular(w: Column) -> Column:
        long_ = F.length(w) > 4
        return F.when(long_ & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(long_ & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.array_join(F.transform(words, singular), " ")


def prompt_fingerprint(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 24)


def slugify(text: Column, sep: str = "-", limit: int = 96) -> Column:
    """Lower-case words joined by ``sep``."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", sep), F.lit(sep)), 1, limit)


def titleize(slug: Column) -> Column:
    return F.initcap(F.btrim(F.regexp_replace(slug, "[-_]+", " ")))


def is_subset(tokens: Column, of: Column) -> Column:
    return F.size(F.array_except(tokens, of)) == 0


def to_number(text: Column, kind: str = "double") -> Column:
    """Tolerant numbers: commas go, blanks are null, an integer truncates."""
    d = F.regexp_replace(F.btrim(text), ",", "").try_cast("double")
    return d.cast("bigint") if kind == "int" else d


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the parts as JSON in order of name."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def title_case(text: Column) -> Column:
    """Every run of letters with its first in upper case and the rest in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def draft_taxonomy(prompt: Column, vertical: Column, cluster: Column, cluster_vertical: Column, cluster_label: Column) -> Column:
    """Array of three draft templates (vertical, cluster, template_key, label, sub_intent, template_score) of a prompt. The slug of an
    existing vertical in focus, or the slug, vertical and label of an existing cluster, stand in for what is made from the prompt."""
    named = lambda slug, default: F.when(slug != "", slug).otherwise(default)
    v = F.coalesce(cluster_vertical, vertical, named(slugify(F.element_at(F.split(prompt, " in ", 2), 1), "_", 64), "draft"))
    k = F.coalesce(cluster, named(slugify(prompt, "_", 64), "draft"))
    label = F.coalesce(cluster_label, F.substring(title_case(F.btrim(prompt)), 1, 128))
    template = lambda i, word: F.struct(
        v.alias("vertical"), k.alias("cluster"), slugify(F.concat(k, F.lit(f"-{word}")), "-", 96).alias("template_key"), F.substring(F.concat(label, F.lit(f" {word.title()}")), 1, 128).alias("label"),
        F.lit(word).alias("sub_intent"), F.lit(max(40, 70 - 5 * i)).alias("template_score"),
    )
    return F.array(*[template(i, w) for i, w in enumerate(("core", "premium", "specialty"), start=1)])
