"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import alignment, language, licences, lines, mixing, negatives, neighbours, ngram_join, packing, quality, repeats, secrets, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = licences.scan_licences(docs, licences.train_licence_model(docs))
    return found.select(
        "doc_id", "n_paragraphs", F.array_sort(F.array_distinct("matches.family")).alias("families"), F.size("matches").cast("long").alias("n_matches"),
        "matches.line_no", "matches.end_line", F.round(F.array_min("matches.probability"), 6).alias("least_probability"), F.round(F.array_min("matches.similarity"), 6).alias("least_similarity"),
    )


def op5_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train_language_model(docs.where(~_held_out()))
    return language.predict_languages(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.build_index(_table(spark, sf_dir, "embeddings"))
    return neighbours.search(index, index.where("vec_id % 50 = 0")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = negatives.build_index(vectors, label=negatives.relabelled(F.col("vec_id"), F.col("label")))
    return negatives.mine_negatives(index, index.where("vec_id % 100 = 0"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = [r.kind for r in secrets.BASE]
    of = lambda kinds: F.filter(spans, lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(of(base)), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_fuzzy_lines, op2_source_mix, op3_ngram_join, op4_licence_scan, op5_byte_repeats, op6_quality_rules, op7_token_shards, op8_lexical_packing, op9_language_id, op10_nearest_vectors, op11_hard_negatives, op12_token_alignment, op13_secret_scan)}

_MOMENTS = "\n".join(
    f"""
  , p_{r} as (
    with m as (select sum(f_{r}) * 1.0 / sum(n) as m, sum(n) as total, count(*) as h, sum(n * n * 1.0) as n2 from hosts),
    s as (select m, total, h, total - n2 / total as scale, m * (1 - m) as chance,
                 (select sum(n * (f_{r} * 1.0 / n - m.m) * (f_{r} * 1.0 / n - m.m)) from hosts) as ss from m),
    v as (select m, chance, case when scale > 0 then (ss - (h - 1) * chance) / scale else 0.0 end as v from s)
    select m, case when v <= chance / 10000.0 then 10000.0 else greatest(1.0, chance / v - 1) end as k from v)"""
    for r in quality.RULES
)
_HOST_FAILED = "greatest(" + ", ".join(f"(f_{r} + p_{r}.k * p_{r}.m) / (n + p_{r}.k)" for r in quality.RULES) + ") > 0.8"
_SPANS = "\n".join(
    f"""
  union all select doc_id, {place} as place, '{r.kind}' as kind, unnest(list_zip(list_transform(list_slice(string_split_regex(t, {q}), 1, -2), lambda x: length(x)),
    list_transform(regexp_extract_all(t, {q}), lambda x: length(x)), list_transform(regexp_extract_all(t, {q}, {r.group}), lambda x: length(x) >= {r.least}))) as m, generate_subscripts(regexp_extract_all(t, {q}), 1) as k from d where regexp_matches(t, {q})"""
    for place, r in enumerate(secrets.RULES) for q in ["'" + r.pattern.replace("'", "''") + "'"]
).strip().removeprefix("union all")
_IS_BASE = "kind in (" + ", ".join(f"'{r.kind}'" for r in secrets.BASE) + ")"
ORACLE_SQL = {
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as c
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_dot_product(a.c, b.c)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and n.label <> n.anchor_label and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) <= 5""",
    "op13_secret_scan": f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({_SPANS}),
e as (select doc_id, place, kind, m[2] as hit, m[3] as kept, sum(m[1] + m[2]) over (partition by doc_id, kind order by k) as stop from m),
f as (select doc_id, kind, place, stop - hit as start, kind || ':' || (stop - hit)::bigint || ':' || stop::bigint as span from e where kept),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(span, ',' order by start, place) filter ({_IS_BASE}) as base, string_agg(span, ',' order by start, place) as spans from f group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)""",
    "op6_quality_rules": rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as g from w, unnest(generate_series(1, len(ws) - 7)) as u(i)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, sum(least(8, nxt - i)) as c from (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 8) as nxt from rep) group by doc_id),
f as (select w.doc_id, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
      len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c, 0)::bigint as n_repeat_words
      from w left join cov on w.doc_id = cov.doc_id),
hosts as (select source, count(*) as n, {', '.join(f"sum(({rule})::int) as f_{name}" for name, rule in quality.RULES.items())} from f group by source)
{_MOMENTS}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not ({_HOST_FAILED}) as kept
from f join hosts on f.source is not distinct from hosts.source, {', '.join(f"p_{r}" for r in quality.RULES)}""",
}
