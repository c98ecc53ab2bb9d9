"""Recorded planner answers: JSON text read as VARIANT, checked and repaired field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import prompts as p
from brindle.functions.values import once

# Strategies as answers write them, and as the library calls them.
STRATEGIES = (
    ("overpass_discovery_enrich", "map"), ("browser_assisted_discovery", "browser"), ("website_first", "website"), ("hybrid_discovery", "hybrid"), ("directory_expansion", "directory"),
)


def text_field(v: Column, path: str) -> Column:
    """A field that is text and not blank, trimmed; else null. Numbers and objects are not read as text."""
    return once(F.try_variant_get(v, path, "variant"), _text)


def _text(found: Column) -> Column:
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.btrim(F.try_variant_get(found, "$", "string")), F.lit("")))


def number_field(v: Column, path: str) -> Column:
    """A number, or text that reads as one, cut to a whole number; else null. Booleans are no numbers."""
    return once(F.try_variant_get(v, path, "variant"), _number)


def _number(found: Column) -> Column:
    plain = lambda kind: ~kind.isin("BOOLEAN", "VOID") & ~kind.rlike("^(OBJECT|ARRAY)")
    n = F.when(once(F.schema_of_variant(found), plain), F.try_variant_get(found, "$", "string").try_cast("double"))
    return once(n, lambda n: F.when(~F.isnan(n), F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")))


def metric(json: Column, path: str) -> Column:
    """One number of a column of metrics; null for JSON that is broken or lacks it."""
    return number_field(F.try_parse_json(json), path)


def _score(x: Column, path: str, default: Column) -> Column:
    return F.least(F.greatest(F.coalesce(number_field(x, path), default), F.lit(0)), F.lit(100)).cast("int")


def _variant(x: Column) -> Column:
    """A variant with its key null where it cannot be used. The template's key stands in for a missing key, the key for a missing label, the
    sum of both parts for a missing fit; scores go into 0 to 100."""
    known = F.create_map(*[F.lit(s) for pair in STRATEGIES for s in pair])
    names = F.struct(F.coalesce(text_field(x, "$.variant_key"), text_field(x, "$.template_key")).alias("key"), F.try_element_at(known, F.lower(text_field(x, "$.source_strategy"))).alias("strategy"))
    parts = (_score(x, "$.template_score", F.lit(50)) + _score(x, "$.prompt_match_score", F.lit(0))).cast("long")
    return once(names, lambda n: F.struct(
        F.when(n["strategy"].isNotNull(), n["key"]).alias("variant_key"), F.coalesce(text_field(x, "$.label"), p.titleize(n["key"])).alias("label"), n["strategy"].alias("strategy"), _score(x, "$.fit_score", parts).alias("fit_score"),
    ))


def read_answer(raw: Column) -> Column:
    """Struct (error, cluster, vertical, variants, dropped, default_key) of an answer's text.

    ``error`` says why the answer as a whole cannot be used: ``no answer`` (null or blank), ``not JSON`` (broken, or no object), ``no cluster`` (no text for
    vertical or slug), ``no variant`` (none, or none that is usable). A variant needs a key and a known strategy; others are dropped and counted, of
    equal keys the first stays. Fields beyond these are ignored. A default that is not among the variants is the first variant.
    """
    return once(F.try_parse_json(raw), lambda v: once(_fields(v), lambda x: once(F.transform(x["usable"], lambda u: u["variant_key"]), lambda keys: _judged(raw, x, keys))))


def _fields(v: Column) -> Column:
    """What an answer says, each field by itself; ``usable`` are the variants with a key."""
    given = F.coalesce(F.try_variant_get(v, "$.variants", "array<variant>"), F.array().cast("array<variant>"))
    return once(given, lambda given: F.struct(
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"), text_field(v, "$.cluster_choice.cluster_slug").alias("cluster"), text_field(v, "$.cluster_choice.vertical").alias("vertical"),
        text_field(v, "$.default_variant_key").alias("default"), F.size(given).alias("given"), F.filter(F.transform(given, _variant), lambda x: x["variant_key"].isNotNull()).alias("usable"),
    ))


def _judged(raw: Column, x: Column, keys: Column) -> Column:
    """The answer of its fields; ``keys`` are those of its usable variants."""
    error = F.when(F.coalesce(F.btrim(raw), F.lit("")) == "", "no answer").when(~x["is_object"], "not JSON").when(x["cluster"].isNull() | x["vertical"].isNull(), "no cluster").when(F.size(keys) == 0, "no variant")
    return once(F.filter(x["usable"], lambda u, i: F.array_position(keys, u["variant_key"]) == i + 1), lambda firsts: F.struct(
        error.alias("error"), x["cluster"].alias("cluster"), x["vertical"].alias("vertical"), firsts.alias("variants"), (x["given"] - F.size(firsts)).alias("dropped"),
        F.when(F.array_contains(keys, x["default"]), x["default"]).otherwise(F.try_element_at(keys, F.lit(1))).alias("default_key"),
    ))
