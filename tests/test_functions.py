import pytest
from pyspark.sql import functions as F

from brindle.functions import contacts, html, markup, prompts, scores, urls


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_urls(spark):
    keys = {"https://WWW.Example.com/Path/?q=1": "example.com/Path", "example.com": "example.com", "http://a.com:8080/": "a.com:8080", " ": None, None: None, "https:///x": None}
    for url, key in keys.items():
        assert one(spark, urls.website_key, url) == key
    assert one(spark, urls.host_key, "https://www.a.com:443/x") == "a.com" and one(spark, urls.host_key, "http://a.com:8080") == "a.com:8080"
    assert one(spark, urls.resolved_page_key, "https://a.com/b/?q") == "a.com|/b" and one(spark, urls.resolved_page_key, "https://a.com") == "a.com|/"
    for href, want in {"/x": "https://a.com/x", "//b.org/y": "https://b.org/y", "z": "https://a.com/p/z", "http://c": "http://c", "?k": "https://a.com/p/q?k"}.items():
        assert one(spark, lambda h: urls.absolute_url(F.lit("https://a.com/p/q"), h), href) == want
    assert one(spark, urls.is_social_or_chat, "https://m.facebook.com/x") and not one(spark, urls.is_social_or_chat, "https://notfacebook.com")
    assert one(spark, urls.company_website, "wa.me/1") is None and one(spark, urls.company_website, "a.com") == "https://a.com"
    assert one(spark, lambda u: urls.same_site_family(u, F.lit("https://shop.a.com")), "a.com")


PAGE = """<html><head><title> A &amp; B </title><script>var t="</p><a href='no'>";</script></head><body><!-- <a href="no2"> -->
<p>Call&nbsp;us</p><a class="x" href="/contact">c</a><a href='mailto:Me@A.com'>m</a><form action="/send"><input name="email" type="EMAIL" required><textarea name="msg"></textarea><div class="g-recaptcha"></div></form></body></html>"""


def test_html(spark):
    page = one(spark, markup.page_parts, PAGE)
    assert [a.href for a in page.links] == ["/contact", "mailto:Me@A.com"] and page.title == "A & B"
    assert page.text == "A & B Call\xa0us c m" and one(spark, html.title, PAGE) == "A &amp; B"
    form = page.forms[0]
    assert (form.action, form.method, form.has_captcha, [(f.name, f.type, f.required) for f in form.fields]) == ("/send", "get", True, [("email", "email", True), ("msg", "textarea", False)])
    assert one(spark, html.decode_protected_email, "2a4b6a48") == "a@b" and one(spark, html.decode_protected_email, "zz") is None
    ld = '<script type="application/ld+json">{"a": {"email": "x@y.org"}, "list": [{"telephone": "+1 2"}]}</script>'
    block = one(spark, lambda h: html.json_ld_blocks(h)[0], ld)
    assert one(spark, lambda b: html.json_ld_values(b, "email"), block) == ["x@y.org"] and one(spark, lambda b: html.json_ld_values(b, "telephone"), block) == ["+1 2"]
    assert one(spark, lambda b: html.json_ld_values(b, "email"), '{"email": "x@y.org"') == []


def test_contacts(spark):
    assert one(spark, contacts.extract_emails, "Z@b.com x@a.org z@B.com bad@x") == ["x@a.org", "z@b.com"]
    for raw, want in {"0066 81 234 5678": "+66812345678", "12345678": None, "call 12:30 now 081": None, "+1 (555) 123-4567 ext 9": "+15551234567", "www.1234567890": None, "1234567890123456": None}.items():
        assert one(spark, contacts.normalize_phone, raw) == want
    assert one(spark, contacts.verifier_phone, "(90) 530-123") == "+90530123"
    assert one(spark, contacts.is_noise_phone, "+1111111111") and one(spark, contacts.is_noise_phone, "123456789") and not one(spark, contacts.is_noise_phone, "+6681")
    assert one(spark, contacts.telegram_handle, "https://t.me/Some_Name") == "@some_name" and one(spark, contacts.telegram_handle, "@ABC") == "@abc" and one(spark, contacts.telegram_handle, "x") is None
    assert one(spark, contacts.tag_values, " a;b | ;c") == ["a", "b", "c"]
    assert [one(spark, contacts.email_syntax_ok, e) for e in ("a.b@c.org", "a..b@c.org", "a@b", "@c.org", None, "x" * 65 + "@c.org")] == [True, False, False, False, False, False]


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("gmial", "gmail", 1), ("ca", "abc", 3), ("gmail", "gmai", 1), ("hotmial", "hotmail", 1), ("kitten", "sitting", 3)])
def test_osa(a, b, n):
    assert contacts.osa(a, b) == n


def test_prompts(spark):
    for raw, want in {"Rent a car in Phuket": "car rental phuket", "complete beauty experience in Thailand": "beauty thailand", "Nails & Spas": "nail spas", "  ": ""}.items():
        assert one(spark, prompts.normalize_prompt, raw) == want
    assert one(spark, prompts.slugify, " A b/C! ") == "a-b-c"
    assert one(spark, lambda x: prompts.to_number(x, "int"), "1,234") == 1234 and one(spark, lambda x: prompts.to_number(x, "int"), "4.7") == 4 and one(spark, prompts.to_number, "") is None


def test_email_scores(spark):
    rows = [(True, True, False, False, False, None), (True, True, False, False, False, "valid"), (True, True, False, False, False, "catch_all"), (True, False, None, None, None, None), (True, True, True, False, False, None), (False, None, None, None, None, None), (True, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s boolean, m boolean, d boolean, r boolean, t boolean, v string")
    df = df.withColumn("score", scores.email_score(*[F.col(c) for c in "smdrtv"])).withColumn("status", scores.email_status(F.col("score"), F.col("s"), F.col("m"), F.col("v")))
    assert [(r.score, r.status) for r in df.collect()] == [(70, "risky"), (100, "valid"), (50, "risky"), (20, "invalid"), (30, "invalid"), (0, "invalid"), (20, "invalid")]


def test_verdicts(spark):
    rows = [(550, "Greylisted, try again", "greylisted", True), (550, "no such user", "invalid", False), (252, "", "unknown", False), (499, None, "unknown", True), (250, "ok", "valid", False), (999, "", "unknown", False)]
    for code, message, verdict, retry in rows:
        got = spark.createDataFrame([(code, message)], "c int, m string").select(scores.reply_verdict(F.col("c"), F.col("m")).alias("v")).first().v
        assert (got.verdict, got.can_retry) == (verdict, retry)
    for target, controls, want in [("valid", ["invalid", "valid"], ("catch_all", False)), ("valid", ["invalid", "greylisted"], ("unknown", True)), ("valid", ["invalid", "invalid"], ("valid", False)), ("invalid", [], ("invalid", False))]:
        got = spark.createDataFrame([(target, controls)], "t string, c array<string>").select(scores.catch_all_verdict(F.col("t"), F.lit(True), F.col("c")).alias("v")).first().v
        assert tuple(got) == want


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(10, 0.5, 0.8)], "n int, w double, d double")
    assert df.select(scores.validation_score(F.col("n"), F.col("w"), F.col("d")).alias("s")).first().s == 52
    df = spark.createDataFrame([(10, 5, 5, 4, 3, 2)], "a int, b int, c int, d int, e int, f int")
    assert df.select(scores.production_score(*[F.col(x) for x in "abcdef"]).alias("s")).first().s == 40
    assert [one(spark, lambda x: scores.greylist_delay_s(x), n, "int") for n in range(1, 6)] == [300, 900, 3600, 14400, 14400]
    assert [one(spark, lambda x: scores.retry_delay_ms(F.lit(45), x), n, "int") for n in range(1, 6)] == [45000, 90000, 135000, 180000, 180000]
