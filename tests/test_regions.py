"""Region hierarchies against a walk in plain Python, and addresses against hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.addresses import read_address, read_label
from brindle.operators import regions

DIVISION = "code string, name string, country_code string, parent_code string"


def walked(parents, max_depth):
    out = {}
    for code in parents:
        at, depth, seen = code, 0, set()
        while True:
            if at not in parents:
                out[code] = (None, None, "unknown parent" if depth <= max_depth else "cycle")
                break
            if at in seen:
                out[code] = (None, None, "cycle")
                break
            if parents[at] is None:
                out[code] = (at, depth, "ok") if depth <= max_depth else (None, None, "cycle")
                break
            seen.add(at)
            at, depth = parents[at], depth + 1
    return out


@pytest.mark.parametrize("max_depth", [3, 64])
def test_tree(spark, max_depth):
    rng = random.Random(5)
    parents = {f"R{i}": None for i in range(3)}
    parents |= {f"D{i}": rng.choice([f"D{rng.randrange(400)}", f"D{max(0, i - 1)}", f"R{rng.randrange(3)}", "R0", "GONE" if i % 3 == 0 else "R1"]) for i in range(400)}
    parents |= {f"C{i}": f"C{i - 1}" if i else "R2" for i in range(12)}
    df = spark.createDataFrame([(k, k, "XX", v) for k, v in parents.items()], DIVISION)
    got = {r.code: (r.root, r.depth, r.state) for r in regions.region_tree(df, max_depth).collect()}
    assert got == walked(parents, max_depth)
    assert {s for *_, s in got.values()} == {"ok", "cycle", "unknown parent"}


def test_tree_of_odd_rows(spark):
    df = spark.createDataFrame([("a ", "x", "XX", None), ("A", "x", "XX", ""), (None, "n", "XX", "A"), ("b", None, None, " a"), ("c", "c", "XX", "c"), ("b", None, None, " a")], DIVISION)
    assert {r.code: (r.root, r.depth, r.state) for r in regions.region_tree(df).collect()} == {"A": ("A", 0, "ok"), "B": ("A", 1, "ok"), "C": (None, None, "cycle")}
    assert regions.region_tree(df.limit(0)).count() == 0


def test_catalog(spark):
    known = regions.countries(spark)
    names = {r.code: r.name for r in known.collect()}
    assert len(names) > 240 and names["DE"] == "Germany" and names["TH"] == "Thailand"
    df = spark.createDataFrame([("TH-10", "Bangkok", "th", None), ("TH-10-1", "Nested", "TH", "TH-10"), ("ZZ-1", "Nowhere", "ZZ", None), ("GB-ENG", "England", "GB", ""), ("TH-10", "Bangkok", "th", None)], DIVISION)
    got = {r.code: (r.name, r.country_code, r.level, r.is_active) for r in regions.region_catalog(known, df, F.col("country_code") == "TH").collect()}
    assert len(got) == len(names) + 2 and got["TH-10"] == ("Bangkok [TH-10], Thailand", "TH", 4, True) and got["GB-ENG"] == ("England [GB-ENG], United Kingdom", "GB", 4, False) and got["TH"] == ("Thailand", "TH", 2, True)


VALID = {
    "user@example.com": "user@example.com", "user+newsletter@example.com": "user+newsletter@example.com", "user@mail.example.co.uk": "user@mail.example.co.uk", "User@Example.COM": "user@example.com", "12345@example.com": "12345@example.com",
    "user@my-company.com": "user@my-company.com", "  user@example.com\t": "user@example.com", "a" * 64 + "@example.com": "a" * 64 + "@example.com", "o'neil@b.org": "o'neil@b.org", "JOSÉ@B.org": "josé@b.org", "a@faß.de": "a@faß.de",
    "a@FAẞ.de": None, "a@ｆｕｌｌ．org": "a@full.org", "a@b.xn--p1ai": "a@b.рф", "a@b.рф": "a@b.рф", "a@3com.org": "a@3com.org", "a@ΒΌΛΟΣ.gr": None,
}
INVALID = ["userexample.com", "user@", "@example.com", "user@@example.com", "user @example.com", "user@localhost", "a" * 65 + "@example.com", "notanemail", "", "   ", "user..name@example.com", ".user@example.com", "user.@example.com", None, '"a b"@c.org', '"ab"@c.org',
           "a​b@c.org", "a@b.c1", "a@́b.org", "a@xn--.org", "a@xn--abc.org", "a@" + ".".join(["b" * 60] * 5) + ".org", "a@ü-.org", "a@b..org", "a@sub.localhost", "a@b,c.org", "a@" + "ü" * 60 + ".org", "a@ü.ü." + "é" * 300]


def test_addresses(spark):
    df = spark.createDataFrame([(e,) for e in [*VALID, *INVALID]], "e string").select("e", read_address(F.col("e")).alias("a"))
    got = {r.e: r.a for r in df.collect()}
    for e, want in VALID.items():
        if want:
            assert (got[e].normalized, got[e].error) == (want, None), e
            assert got[e].local + "@" + got[e].domain == want and got[e].ascii_domain.isascii()
    for e in INVALID:
        assert not got[e].valid and got[e].error and got[e].normalized is None and got[e].domain is None, e
    assert "string" in got[None].error and "empty" in got[""].error and got["   "].error == got[""].error


def test_labels_round_trip():
    for shown in ("bücher", "例え", "рф", "straße", "ñandú", "ไทย"):
        ascii_, again = read_label(shown)
        assert again == shown and read_label(ascii_) == (ascii_, shown) and read_label(ascii_.upper())[1] == shown
    for bad in ("xn--zz", "☃", "\u00ad", "xn--a"):
        with pytest.raises((ValueError, UnicodeError, IndexError)):
            read_label(bad)
