"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a Parquet table with a row for each scan
of a blob: which rules, in which versions, were run on it, and what they found. A run scans only the pairs of blob and rule
version that the ledger does not hold, appends them, and joins the findings back to all paths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.storage import new_folder


class Rule(NamedTuple):
    """Leftmost matches of ``pattern`` that do not overlap; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the base rules. A maximal run of a class that is long enough is what the open pattern keeps after dropping short ones.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
# forms that public services print for private keys, signed web tokens, tokens with a prefix and passwords in URLs; all repeats are bounded
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,900}\.[A-Za-z0-9_-]{10,900}\.[A-Za-z0-9_-]{10,900}"),
    Rule("prefixed", 1, r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,250}"),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{6,100}@"),
)
RULES = BASE + MORE
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """A rule's matches in order: the characters before each since the last one, its own, and whether it counts. What lies
    between matches comes from splitting by the same pattern, so lengths alone give the places."""
    part = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
    hits = F.transform(part(0), F.length)
    kept = F.transform(part(rule.group), lambda g: F.length(g) >= rule.least)
    gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)), F.length)
    made = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("kept")),
        lambda m, k: F.struct(F.lit(rule.name).alias("rule"), k.alias("k"), m["gap"].alias("gap"), m["hit"].alias("hit"), m["kept"].alias("kept")),
    )
    return F.when(text.rlike(rule.pattern), made).otherwise(F.array().cast("array<struct<rule:string,k:int,gap:int,hit:int,kept:boolean>>"))


def _scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, rules: names to run) with the spans found. Places are running sums within a blob and rule, so a text of many
    matches costs no more than sorting them."""
    unseen = lambda r: F.array_contains("rules", r.name)
    none = F.array().cast("array<struct<rule:string,k:int,gap:int,hit:int,kept:boolean>>")
    matches = todo.select("blob", "rules", F.concat(*[F.when(unseen(r), _matches(F.col("text"), r)).otherwise(none) for r in rules]).alias("m"))
    each = matches.select("blob", "rules", F.explode_outer("m").alias("m")).select("blob", "rules", "m.*")
    before = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(before).cast("int"))
    span = F.when(F.col("kept"), F.struct("rule", (F.col("end") - F.col("hit")).alias("start"), "end"))
    return each.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(span).alias("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a ledger; an absent folder is an empty one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` has not seen of ``versions``, append it, and return the new entries.

    Equal texts are one blob, met once in a task before they are moved. Blobs for which every rule version is there are not
    scanned, and a repeated or restarted run appends nothing twice; an interrupted write leaves the ledger as it was.
    """
    spark = versions.sparkSession
    ledger = read_ledger(spark, path)
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    names = F.array(*[F.lit(r.name) for r in rules])
    todo = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    before = ledger.inputFiles()
    _scan(todo, rules).write.mode("append").parquet(path)
    after = sorted(set(spark.read.schema(LEDGER).parquet(path).inputFiles()) - set(before))
    return spark.read.schema(LEDGER).parquet(*after) if after else spark.createDataFrame([], LEDGER)


def blob_id(text: Column) -> Column:
    """The address of a text's UTF-8 bytes; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans: array of (start, place of its rule, kind, end)) of a ledger's entries for these rule versions, ordered by start."""
    by_name = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = ledger.select("blob", F.filter("found", lambda s: s["rule"].isin([r.name for r in rules])).alias("found"))
    spans = lambda f: F.transform(f, lambda s: F.struct(s["start"].alias("start"), F.element_at(by_name, s["rule"]).alias("place"), s["end"].alias("end")))
    merged = found.groupBy("blob").agg(F.array_sort(F.array_distinct(spans(F.flatten(F.collect_list("found"))))).alias("f"))
    return merged.select("blob", F.transform("f", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), F.element_at(kinds, s["place"] + 1).alias("kind"), s["end"].alias("end"))).alias("spans"))


def scan_secrets(versions: DataFrame, path: str | None = None, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of ``versions``: the columns ``keep``, its blob, and the spans of all rules, found now or before.

    ``path`` is the ledger's folder; without one a new ledger is made in the shared folder. Null and empty texts have no spans.
    Repeated rows and equal texts of different paths each get their row; an empty table gives none; other columns are not
    read. Places are counted in code points. A change of a rule is a new version of it: only that rule is run again.
    """
    spark = versions.sparkSession
    path = path or new_folder(spark, "ledger")
    update_ledger(versions, path, rules=rules, text_col=text_col)
    found = blob_findings(read_ledger(spark, path), rules).withColumnRenamed("blob", "found_blob")
    paths = versions.select(*keep, blob_id(F.col(text_col)).alias("blob"))
    return paths.join(found, F.col("blob") == F.col("found_blob"), "left").drop("found_blob")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
