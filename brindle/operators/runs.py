"""Run yield, progress and due dates. Every test of time takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scores

TERMINAL = ("completed", "failed", "skipped")


def progress(rows: DataFrame) -> DataFrame:
    """Counts of each state per run in one pass, and the share that has ended."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), n("queued").alias("queued"), n("running").alias("running"), n(*TERMINAL).alias("ended"))
    return out.withColumn("percent", F.bround(100.0 * F.col("ended") / F.col("total"), 2)).withColumn("done", (F.col("queued") + F.col("running")) == 0)


def variant_totals(stats: DataFrame, keys: list[str]) -> DataFrame:
    names = ("discovered", "crawled", "website", "contact", "email", "phone")
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in names], F.bround(F.avg("score"), 0).cast("int").alias("score"))


def yield_scores(totals: DataFrame) -> DataFrame:
    c = F.col
    return totals.withColumn("yield_score", scores.production_score(c("discovered"), c("crawled"), c("website"), c("contact"), c("email"), c("phone")))


def recrawl_due(website: Column, status: Column, last_crawl: Column, as_of: Column, hours: int) -> Column:
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last_crawl.cast("timestamp"))
    return F.when(website.isNull() | (website == ""), False).when(status.isin("pending", "failed", "blocked_by_robots"), True).when(last_crawl.isNull(), True).when(F.lit(hours) <= 0, True).otherwise(age >= hours * 3600)


def quota_ok(used: Column, n: Column, cap: Column) -> Column:
    """A cap of 0 or less is no cap."""
    return (cap <= 0) | (used + n <= cap)


def before_and_after(audits: DataFrame, stats: DataFrame, days: int = 7) -> DataFrame:
    """Figures of the ``days`` before and after each audit, from running sums: no audit meets a run.

    Whole-number sums of a window are those before its end less those before its start. Runs are added up by instant and by day; what comes
    before an instant on its day is a running sum over the instants of that day, and the days between two instants are looked up."""
    c = F.col
    day = lambda x: F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date"))
    names = ("score", "discovered", "crawled", "contact", "email", "phone")
    sums = ["runs", *[f"{k}_{x}" for x in names for k in ("n", "sum")]]
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    instants = stats.where("created_at is not null").groupBy(c("created_at").alias("at")).agg(
        F.count(F.lit(1)).alias("runs"), *[e for x in names for e in (F.count(x).alias(f"n_{x}"), zero(F.sum(c(x).cast("long"))).alias(f"sum_{x}"))]
    ).withColumn("day", day(c("at")))
    span = F.expr(f"interval {days} days")
    moments = audits.where("changed_at is not null").select("changed_at").distinct()
    ends = F.array(F.struct(F.lit("before").alias("side"), (c("changed_at") - span).alias("start"), c("changed_at").alias("end")), F.struct(F.lit("after").alias("side"), c("changed_at").alias("start"), (c("changed_at") + span).alias("end")))
    windows = moments.select("changed_at", F.inline(ends))
    edges = windows.select("changed_at", "side", F.inline(F.array(F.struct(c("start").alias("at"), F.lit(-1).alias("sign")), F.struct(c("end").alias("at"), F.lit(1).alias("sign"))))).withColumn("day", day(c("at")))
    marks = edges.select("at", "day").distinct()
    # Of one instant the mark comes first: its own runs are not before it.
    both = instants.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("day").orderBy("at", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    before = both.select("at", "mark", *[zero(F.sum(x).over(w)).alias(x) for x in sums]).where("mark").drop("mark")
    parts = edges.join(before, "at").select("changed_at", "side", *[(c("sign") * c(x)).alias(x) for x in sums])
    between = windows.withColumn("day", F.explode(F.filter(F.sequence(day(c("start")), day(c("end"))), lambda d: d < day(c("end")))))
    whole = between.join(instants.groupBy("day").agg(*[F.sum(x).alias(x) for x in sums]), "day").select("changed_at", "side", *sums)
    add = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sums])
    found = add(parts.unionByName(whole), "changed_at", "side").where("runs > 0")
    t = add(audits.select("audit_id", "changed_at").join(found, "changed_at"), "audit_id", "side")
    of = lambda x: F.when(c(f"n_{x}") > 0, c(f"sum_{x}"))
    rate = lambda x: F.bround(100.0 * of(x) / F.greatest(of("discovered"), F.lit(1)), 2).alias(x)
    return t.select("audit_id", "side", "runs", F.bround(F.try_divide(of("score").cast("double"), c("n_score").cast("double")), 2).alias("score"), *[rate(x) for x in names[2:]])


def draft_counts(generations: DataFrame, **children: DataFrame) -> DataFrame:
    """Counts of each kind of child per generation; every child is reduced before its left join, none counts 0."""
    out = generations
    for name, rows in children.items():
        out = out.join(rows.groupBy("generation_id").agg(F.count(F.lit(1)).alias(name)), "generation_id", "left")
    return out.select(*generations.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in children])


def discovery(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(category rows, run rows) of discovery over the categories of each run, in order of ``category_id``.

    states: run_id, category_id, slug, force, due (its last scan is too old), error (of the scan, else null), found, last_count, remaining
    (scans the day still allows the run). A category that is forced or due is scanned while scans remain; the first that finds
    none left ends the run, those after it are untouched. A failed scan uses no unit. A run has as many rows as categories.
    """
    w = Window.partitionBy("run_id").orderBy("category_id").rowsBetween(Window.unboundedPreceding, -1)
    scan = F.col("force") | F.col("due")
    used = F.coalesce(F.sum((scan & F.col("error").isNull()).cast("int")).over(w), F.lit(0))
    rows = states.withColumn("_scan", scan).withColumn("_over", scan & (used >= F.col("remaining")))
    rows = rows.withColumn("_ended", F.coalesce(F.max("_over").over(w), F.lit(False)))
    fresh = F.when(F.col("force"), "fresh_forced").otherwise("fresh")
    status = F.when(F.col("_ended"), "untouched").when(F.col("_over"), "rate_limited").when(~F.col("_scan"), "cached").when(F.col("error").isNotNull(), "failed").otherwise(fresh)
    rows = rows.withColumn("status", status)
    ok = F.col("status").isin("fresh", "fresh_forced")
    count = F.when(ok, F.col("found")).when(F.col("status") == "cached", F.col("last_count")).otherwise(0)
    failed = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("category_id", F.concat("slug", F.lit(": "), F.substring("error", 1, 300)).alias("t"))))), lambda x: x["t"])
    limited, any_ok = F.bool_or(F.col("status") == "rate_limited"), F.bool_or(ok | (F.col("status") == "cached"))
    t = rows.groupBy("run_id").agg(F.sum(count).alias("discovered"), F.count_if(ok).alias("queries_used"), failed.alias("errors"), limited.alias("limited"), any_ok.alias("any_ok"), F.max("remaining").alias("cap"))
    none = (F.size("errors") > 0) & ~F.col("any_ok")
    joined = F.array_join("errors", " ; ")
    note = (
        F.when(none, joined).when(F.size("errors") > 0, F.concat(F.lit("Discovery completed. Partial category failures: "), joined))
        .when(F.col("limited"), F.concat(F.lit("Daily cap reached ("), F.col("queries_used").cast("string"), F.lit("/"), F.col("cap").cast("string"), F.lit(").")))
        .otherwise("Discovery completed.")
    )
    outcome = F.when(none, "failed").when(F.col("limited"), "skipped").otherwise("running")
    return rows.select("run_id", "category_id", "status"), t.select("run_id", "discovered", "queries_used", outcome.alias("status"), F.substring(note, 1, 2000).alias("note"))


def validate_recipes(recipes: DataFrame, cached: DataFrame, elements: DataFrame) -> DataFrame:
    """Validation of recipes (recipe_id, status) without a valid cached one, from elements (recipe_id, name, website) of the sampled
    regions: figures, score, the version's status, and the recipe's, which only a draft or a validated result changes."""
    todo = recipes.select("recipe_id", F.col("status").alias("old_status")).join(cached.select("recipe_id"), "recipe_id", "left_anti")
    per = elements.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("website") != "").alias("with_website"), F.countDistinct(F.when(F.col("name") != "", F.lower(F.btrim("name")))).alias("names"),
    )
    zero = lambda n: F.coalesce(n, F.lit(0))
    t = todo.join(per, "recipe_id", "left").select("recipe_id", "old_status", zero("n").alias("total_results"), zero("with_website").alias("with_website"), zero("names").alias("distinct_names"))
    rate = lambda n: F.coalesce(F.bround(F.try_divide(n, "total_results"), 4), F.lit(0.0))
    t = t.select("*", rate("with_website").alias("website_rate"), rate("distinct_names").alias("name_rate"))
    t = t.withColumn("score", scores.validation_score(F.col("total_results"), F.col("website_rate"), F.col("name_rate")))
    t = t.withColumn("version_status", scores.validation_status(F.col("total_results"), F.col("score")))
    moves = (F.col("old_status") == "draft") | (F.col("version_status") == "validated")
    return t.withColumn("recipe_status", F.when(moves, F.col("version_status")).otherwise(F.col("old_status"))).drop("old_status")
