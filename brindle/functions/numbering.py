"""Phone numbers read by national numbering plans."""

from __future__ import annotations

import csv
import functools
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import html
from brindle.functions.contacts import normalize_phone

PLAN = Path(__file__).resolve().parents[1] / "sources" / "numbering_plan.csv"


class Country(NamedTuple):
    """A region's calling code, its prefixes for calls abroad and within the country, and the lengths of its numbers without either."""

    region: str
    code: str
    idd: str
    trunk: str
    least: int
    most: int


@functools.cache
def read_plan(path: str = str(PLAN)) -> tuple[Country, ...]:
    with open(path, encoding="utf-8", newline="") as f:
        return tuple(Country(r["region"], r["code"], r["idd"], r["trunk"], int(r["least"]), int(r["most"])) for r in csv.DictReader(f))


EXTENSIONS = (r"(?i)(ext|extension|x)\s*\d+$", r"(?i)[\s,;]*(ext(ension)?[.]?|#)[:=\s]*\d{1,7}$")
_FIELDS = "code string, idd string, trunk string, least int, most int"


def by_region(spark: SparkSession, plan: tuple[Country, ...]) -> DataFrame:
    """(_region, own): the plan as a table of regions."""
    return spark.createDataFrame([(c.region, tuple(c[1:])) for c in plan], f"_region string, own struct<{_FIELDS.replace(' ', ':')}>".replace(",:", ","))


def by_prefix(spark: SparkSession, plan: tuple[Country, ...]) -> DataFrame:
    """(_prefix, there): the plan as a table of the first three digits of numbers with a calling code. Codes are prefix-free, so three digits
    have one code; of regions that share one the first stands for all."""
    codes: dict[str, Country] = {}
    for c in plan:
        codes.setdefault(c.code, c)
    rows = [(f"{code}{more:0{3 - len(code)}d}" if len(code) < 3 else code, tuple(c[1:])) for code, c in codes.items() for more in range(10 ** (3 - len(code)))]
    return spark.createDataFrame(rows, f"_prefix string, there struct<{_FIELDS.replace(' ', ':')}>".replace(",:", ","))


def _after(text: Column, head: Column) -> Column:
    return F.substr(text, F.length(head) + 1)


def _cut(number: Column, entry: Column) -> Column:
    """A number without its calling code, without its trunk prefix. No number begins with 0 behind a trunk prefix that does;
    another prefix goes only from a number that is too long with it."""
    fits = lambda n: F.length(n).between(entry["least"], entry["most"])
    bare = _after(number, entry["trunk"])
    return F.when((entry["trunk"] != "") & number.startswith(entry["trunk"]) & (entry["trunk"].startswith("0") | (~fits(number) & fits(bare))), bare).otherwise(number)


def _e164(cut: Column, entry: Column) -> Column:
    return F.when(F.length(cut).between(entry["least"], entry["most"]), F.concat(F.lit("+"), entry["code"], cut))


def read_numbers(df: DataFrame, value: str, region: str, out: str = "phone", plan: tuple[Country, ...] | None = None) -> DataFrame:
    """``df`` with ``out``: the number in ``value`` as E.164, read with the plan of ``region`` (a two-letter code; null or unknown: international
    numbers only).

    In turn: a number with ``+`` or the region's prefix for calls abroad, by its calling code; a national number, without its trunk prefix;
    a national number that begins with the region's own code. Each must have a length of its plan. What no plan reads falls back to
    :func:`contacts.normalize_phone`, whose guards (links, over three letters, over 64 characters, times) hold for all. Null stays null.
    The plan comes in by two joins with tables of under 1,100 rows, so rows neither move nor multiply.
    """
    spark, plan, c = df.sparkSession, plan or read_plan(), F.col
    text = html.unescape(c(value))
    for pattern in EXTENSIONS:
        text = F.regexp_replace(text, pattern, "")
    text, t = F.btrim(text), c("_text")
    rows = df.withColumn("_text", text).withColumn("_at", F.upper(c(region)))
    allowed = ~t.contains("://") & ~F.lower(t).contains("www.") & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) <= 3) & (F.length(t) <= 64) & ~t.rlike(r"\b\d{1,2}[.:]\d{2}\b")
    rows = rows.withColumns({"_allowed": allowed, "_digits": F.regexp_replace(t, r"\D", ""), "_plus": t.rlike(r"^[^\d+]*[+＋]")})
    rows = rows.join(by_region(spark, plan), c("_at") == c("_region"), "left")
    rows = rows.withColumn("_full", F.when(c("_plus"), c("_digits")).when(c("_digits").startswith(c("own.idd")), _after(c("_digits"), c("own.idd"))))
    rows = rows.join(by_prefix(spark, plan), F.substring("_full", 1, 3) == c("_prefix"), "left")
    own, there = c("own"), c("there")
    rows = rows.withColumns({
        "_abroad": _cut(_after(c("_full"), there["code"]), there), "_within": F.when(~c("_plus"), _cut(c("_digits"), own)),
        "_coded": F.when(~c("_plus") & c("_digits").startswith(own["code"]), _cut(_after(c("_digits"), own["code"]), own)),
    })
    found = F.when(c("_allowed"), F.coalesce(_e164(c("_abroad"), there), _e164(c("_within"), own), _e164(c("_coded"), own), normalize_phone(t)))
    return rows.select(*[df[x] for x in df.columns], found.alias(out))
