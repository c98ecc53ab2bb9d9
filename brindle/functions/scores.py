"""Scores, verdicts and states as column expressions. Rounding is half to even (``bround``) throughout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

GREYLIST_PHRASES = ("greylist", "greylisted", "try again", "try later", "temporarily", "come back", "too fast")
VERDICTS = ("valid", "invalid", "catch_all", "greylisted", "unknown")


def email_score(syntax_valid: Column, mx_found: Column, is_disposable: Column, is_role_based: Column, has_typo: Column, verdict: Column) -> Column:
    """Deliverability 0 to 100. Null is a layer that was skipped: neither credit nor loss. Bad syntax gives 0, no mail
    host the points so far."""
    either = lambda c, yes, no: F.when(c.isNull(), 0).when(c, yes).otherwise(no)
    probe = F.when(verdict == "valid", 30).when(verdict == "invalid", -60).when(verdict == "catch_all", -20).when(verdict.isin("greylisted", "unknown"), -5).otherwise(0)
    points = F.lit(20) + F.when(mx_found, 20).otherwise(0) + either(is_disposable, -25, 15) + either(is_role_based, -10, 10) + either(has_typo, 0, 5) + probe
    return F.when(~F.coalesce(syntax_valid, F.lit(False)), 0).when(mx_found.eqNullSafe(F.lit(False)), 20).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))


def email_status(score: Column, syntax_valid: Column, mx_found: Column, verdict: Column) -> Column:
    fatal = ~F.coalesce(syntax_valid, F.lit(False)) | mx_found.eqNullSafe(F.lit(False))
    return (
        F.when(fatal | (verdict == "invalid"), "invalid").when(verdict.isin("greylisted", "unknown"), "unknown").when(verdict == "catch_all", "risky")
        .when(verdict.isNotNull(), F.when(score >= 80, "valid").when(score >= 50, "risky").otherwise("invalid")).otherwise(F.when(score >= 60, "risky").otherwise("invalid"))
    )


def reply_verdict(code: Column, message: Column) -> Column:
    """A recorded mail server reply as (verdict, can_retry); phrases go before codes."""
    low, phrase = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for p in GREYLIST_PHRASES:
        phrase = phrase | low.contains(p)
    out = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("can_retry"))
    return (
        F.when(phrase, out("greylisted", True)).when(code.isin(250, 251), out("valid", False)).when(code.isin(550, 551, 553, 554), out("invalid", False))
        .when(code.isin(421, 450, 451, 452), out("greylisted", True)).when(code == 252, out("unknown", False)).when(code.between(400, 499), out("unknown", True)).otherwise(out("unknown", False))
    )


def catch_all_verdict(target: Column, target_can_retry: Column, controls: Column) -> Column:
    """(verdict, can_retry) from a probe of the address and of made-up control addresses."""
    has = lambda *v: F.exists(controls, lambda c: c.isin(*v))
    out = lambda v, r: F.struct(F.lit(v).alias("verdict"), r.alias("can_retry"))
    return (
        F.when(target == "invalid", out("invalid", F.lit(False))).when(target.isin("unknown", "greylisted"), out("unknown", target_can_retry))
        .when(has("valid"), out("catch_all", F.lit(False))).when(has("greylisted", "unknown"), out("unknown", F.lit(True))).otherwise(out("valid", F.lit(False)))
    )


def validation_score(results: Column, website_rate: Column, name_rate: Column) -> Column:
    s = F.least(F.lit(100), F.bround(F.least(results, F.lit(40)) * 1.5 + website_rate * 35 + name_rate * 25, 0).cast("int"))
    return F.when(results == 0, 10).otherwise(s)


def validation_status(results: Column, score: Column) -> Column:
    return F.when(results == 0, "candidate").when(score >= 70, "validated").when(score >= 35, "candidate").otherwise("draft")


def production_score(discovered: Column, crawled: Column, website: Column, contact: Column, email: Column, phone: Column) -> Column:
    base = F.greatest(discovered, F.lit(1))
    return F.bround(website / base * 25 + crawled / base * 20 + contact / base * 15 + email / base * 30 + phone / base * 10, 0).cast("int")


def capped_bonus(score: Column, count: Column, factor: float, cap: int) -> Column:
    """A share of a score that grows with evidence up to ``cap`` observations. (factor, cap): validation (0.4, 5),
    production (0.3, 5), market (0.25, 4), strategy (0.2, 6)."""
    return F.when((score <= 0) | (count <= 0), 0).otherwise(F.bround(score * factor * (F.least(count, F.lit(cap)) / cap), 0).cast("int"))


def adoption_bonus(adopted: Column, cluster_adopted: Column) -> Column:
    return F.least(adopted, F.lit(6)) * 2 + F.least(cluster_adopted, F.lit(12))


def conversion_bonus(selected: Column, drafted: Column, activated: Column, market: bool = False) -> Column:
    cap, d, a = (6, 1, 2) if market else (8, 2, 4)
    return F.least(selected, F.lit(cap)) + F.least(drafted, F.lit(cap)) * d + F.least(activated, F.lit(cap)) * a


def policy_outcome(before: Mapping[str, Column], after: Mapping[str, Column]) -> Column:
    """(outcome, delta) of two windows with keys runs, score, contact, email, phone, crawl; three runs each at least."""
    weigh = lambda w: w["score"] * 0.4 + w["contact"] * 0.2 + w["email"] * 0.2 + w["phone"] * 0.1 + w["crawl"] * 0.1
    short = (F.coalesce(before["runs"], F.lit(0)) < 3) | (F.coalesce(after["runs"], F.lit(0)) < 3)
    delta = F.bround(weigh(after) - weigh(before), 0).cast("int")
    word = F.when(delta >= 5, "improved").when(delta <= -5, "degraded").otherwise("neutral")
    return F.struct(F.when(short, "insufficient_data").otherwise(word).alias("outcome"), F.when(~short, delta).alias("delta"))


EVIDENCE = (
    "validation_score", "validation_count", "production_score", "production_runs", "planner_selected", "planner_drafted", "planner_activated", "market_selected", "market_drafted",
    "market_activated", "prompt_selected", "prompt_drafted", "prompt_activated", "market_score", "market_runs", "strategy_score", "strategy_runs",
)


def recommendation(e: Mapping[str, Column], floor: Mapping[str, Column]) -> Column:
    """(state, score, rank_bonus) of a variant from its evidence (keys EVIDENCE) and a strategy's thresholds (keys validation_score,
    validation_runs, production_score, production_runs). Suppressed goes before trusted before recommended."""
    vs, vr, ps, pr = (floor[k] for k in ("validation_score", "validation_runs", "production_score", "production_runs"))
    lit = F.lit
    valid = (e["validation_count"] >= vr) & (e["validation_score"] >= vs)
    produced = ~(pr > 0) | ((e["production_runs"] >= pr) & (e["production_score"] >= ps))
    activated = e["planner_activated"] + e["market_activated"] + e["prompt_activated"]
    drafted = e["planner_drafted"] + e["market_drafted"] + e["prompt_drafted"]
    selected = e["planner_selected"] + e["market_selected"] + e["prompt_selected"]
    part = lambda count, score, by, cap: F.when(count > 0, F.least(F.floor(score / by), lit(cap))).otherwise(0)
    market = e["market_activated"] * 4 + e["market_drafted"] * 2 + e["market_selected"]
    score = (
        F.when(valid, 30).otherwise(0) + part(e["production_runs"], e["production_score"], 5, 20) + part(e["market_runs"], e["market_score"], 8, 10)
        + part(e["strategy_runs"], e["strategy_score"], 10, 8) + F.least(market, lit(10))
        + F.when(activated > 0, F.least(activated * 6, lit(18))).when(drafted > 0, F.least(drafted * 4, lit(12))).when(selected > 0, F.least(selected * 2, lit(8))).otherwise(0)
    )
    weak = (
        (e["validation_count"] >= F.greatest(lit(2), vr)) & (e["validation_score"] <= F.greatest(lit(35), vs - 15))
        & (e["production_runs"] >= F.greatest(lit(1), pr)) & (e["production_score"] <= F.greatest(lit(5), ps - 5))
    )
    trusted = (
        (e["validation_count"] >= F.greatest(vr + 1, lit(2))) & (e["validation_score"] >= F.greatest(vs + 10, lit(65)))
        & (e["production_runs"] >= F.greatest(pr, lit(1))) & (e["production_score"] >= F.greatest(ps + 10, lit(15)))
        & ((activated >= 1) | (drafted >= 2) | (e["market_runs"] >= 2))
    )
    # without a policy the activation floor is 0, which any count meets
    state = F.when(weak, "suppressed").when(trusted, "trusted").when(valid, "recommended").otherwise("experimental")
    return F.struct(
        state.alias("state"), F.when(weak, F.greatest(score - 25, lit(0))).otherwise(score).cast("int").alias("score"),
        F.when(weak, -20).when(trusted, 12).when(valid, 5).otherwise(0).alias("rank_bonus"), produced.alias("production_ready"),
    )


def retry_delay_ms(base_seconds: Column, attempt: Column) -> Column:
    return base_seconds * F.least(attempt, F.lit(4)) * 1000


def greylist_delay_s(attempt: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (300, 900, 3600, 14400)]), F.least(F.greatest(attempt, F.lit(1)), F.lit(4)).cast("int"))


def dead_host(message: Column, no_route: bool = True) -> Column:
    """An error that says the host is gone."""
    words = "no host connection|temporary failure in name resolution|name or service not known|nodename nor servname provided|getaddrinfo failed|failed to resolve|no address associated with hostname|hostname nor servname provided|server misbehaving|dns"
    return F.coalesce(F.lower(message).rlike(words + ("|no route to host" if no_route else "")), F.lit(False))


def dead_host_response(status: Column, reason: Column, body: Column) -> Column:
    low = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 512))
    named = F.replace(F.lower(F.coalesce(reason, F.lit(""))), F.lit(" "), F.lit("_")).contains("no_host_connection")
    return named | F.coalesce(status.isin(521, 522, 523, 530), F.lit(False)) | F.coalesce((status == 502) & (low.contains("no_host_connection") | low.contains("host connection")), F.lit(False))


def size_label(n: Column) -> Column:
    in_unit = lambda size, unit: F.concat(F.format_string("%.1f", F.bround(n / size, 1)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, in_unit(1024, "KB")).otherwise(in_unit(1048576, "MB"))


def cluster_bonus(score: Column, runs: Column) -> Column:
    return F.when(runs <= 0, 0).otherwise(F.bround(score * 0.15 * (F.least(runs, F.lit(8)) / 8), 0).cast("int"))


def fit_score(e: Mapping[str, Column], rank_bonus: Column) -> Column:
    """Fit of a proposal: its template and prompt scores, nine bonuses from history, and the recommendation's bonus.
    Keys: EVIDENCE, template_score, prompt_match_score, cluster_score, cluster_runs, adopted, cluster_adopted."""
    terms = (
        e["prompt_match_score"], capped_bonus(e["validation_score"], e["validation_count"], 0.4, 5), cluster_bonus(e["cluster_score"], e["cluster_runs"]), adoption_bonus(e["adopted"], e["cluster_adopted"]),
        conversion_bonus(e["planner_selected"], e["planner_drafted"], e["planner_activated"]), conversion_bonus(e["market_selected"], e["market_drafted"], e["market_activated"], market=True),
        capped_bonus(e["production_score"], e["production_runs"], 0.3, 5), capped_bonus(e["market_score"], e["market_runs"], 0.25, 4), capped_bonus(e["strategy_score"], e["strategy_runs"], 0.2, 6), rank_bonus,
    )
    out = e["template_score"]
    for t in terms:
        out = out + t
    return out


def suggested_thresholds(now: Mapping[str, Column], seen: Mapping[str, Column], factor: Column) -> dict[str, Column]:
    """Thresholds from observed percentiles, blended with the present ones by ``factor`` and clamped twice: before and
    after the blend. now: rec_val, trust_val, rec_prod, trust_prod, sup_val, sup_prod, rec_act, trust_act; seen: the
    percentile for each, null where nothing was observed."""

    def clamped(v: Mapping[str, Column]) -> dict[str, Column]:
        lit, out = F.lit, {}
        out["rec_val"] = F.greatest(lit(25), F.least(lit(95), v["rec_val"]))
        out["trust_val"] = F.greatest(out["rec_val"] + 5, F.least(lit(100), v["trust_val"]))
        out["rec_prod"] = F.greatest(lit(5), F.least(lit(95), v["rec_prod"]))
        out["trust_prod"] = F.greatest(out["rec_prod"] + 5, F.least(lit(100), v["trust_prod"]))
        out["sup_val"] = F.greatest(lit(0), F.least(out["rec_val"] - 5, v["sup_val"]))
        out["sup_prod"] = F.greatest(lit(0), F.least(out["rec_prod"] - 3, v["sup_prod"]))
        out["rec_act"] = F.greatest(lit(0), F.least(lit(3), v["rec_act"]))
        out["trust_act"] = F.greatest(out["rec_act"] + 1, F.least(lit(5), v["trust_act"]))
        return out

    first = clamped({k: F.coalesce(seen[k], now[k]) for k in now})
    return clamped({k: F.greatest(F.lit(0), now[k] + F.bround((first[k] - now[k]) * factor, 0).cast("int")) for k in now})


# What an activation needs at least (validation score and runs, production score and runs), in all and by strategy.
ACTIVATION_KINDS = ("validation_score", "validation_runs", "production_score", "production_runs")
ACTIVATION_FLOOR = (55, 1, 0, 0)
STRATEGY_FLOORS = {
    "overpass_discovery_enrich": (55, 1, 0, 0), "hybrid_discovery": (58, 1, 5, 1), "website_first": (52, 1, 10, 1),
    "browser_assisted_discovery": (65, 1, 15, 1), "directory_expansion": (60, 1, 10, 1),
}


def activation_floors(strategy: Column, settings: tuple[int, ...] = ACTIVATION_FLOOR) -> Column:
    """Array of (kind, floor): the larger of the settings' floor and the strategy's own; a strategy without one has the settings'."""
    own = lambda i: F.coalesce(*[F.when(strategy == s, f[i]) for s, f in STRATEGY_FLOORS.items()], F.lit(0))
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.greatest(F.lit(settings[i]), own(i)).alias("floor")) for i, k in enumerate(ACTIVATION_KINDS)])
