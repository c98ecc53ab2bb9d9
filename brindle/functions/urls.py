"""URL keys and tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.values import once

# Fixed values.
SOCIAL_HOSTS = ("facebook", "facebook.com", "instagram", "instagram.com", "linkedin", "linkedin.com", "tiktok", "tiktok.com", "youtube", "youtube.com", "wa.me", "api.whatsapp.com", "whatsapp", "telegram", "t.me", "telegram.me")
CONTACT_PATH_HINTS = (
    "contact", "contact-us", "contactus", "about", "about-us", "reservation", "booking", "support", "help", "locations", "branches", "faq", "team", "impressum", "kontakt",
    "contacto", "contato", "contatti", "contactez", "iletisim", "iletişim", "联系我们", "聯絡我們",
)
ASSET_EXTENSIONS = (".js", ".mjs", ".css", ".json")


def with_scheme(url: Column) -> Column:
    """``https://`` before a URL without a scheme; null and empty stay."""
    return F.when(url.isNull() | (url == ""), url).when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column) -> Column:
    """Lower-case authority of a URL that has a scheme; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _candidate(url: Column) -> Column:
    trimmed = F.btrim(url)
    return F.when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def website_key(url: Column) -> Column:
    """Host without one leading ``www.`` (port kept) and path without trailing slashes; null without a host."""
    c = _candidate(url)
    host = F.regexp_replace(F.btrim(netloc(c)), r"^www\.", "")
    return F.when((F.btrim(url) != "") & (netloc(c) != ""), F.concat(host, F.regexp_replace(path(c), "/+$", "")))


def host_key(url: Column) -> Column:
    """Host without ``www.`` and without the default ports 80 and 443."""
    host = F.regexp_replace(netloc(_candidate(url)), r"^www\.", "")
    return F.when(F.btrim(url) != "", F.regexp_replace(host, r":(80|443)$", ""))


def resolved_page_key(url: Column) -> Column:
    """``host|path``: the key under which two fetched pages are the same page."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(netloc(url), F.lit("|"), F.when(p == "", F.lit("/")).otherwise(p))


def _merged_path(base_path: Column, href_path: Column) -> Column:
    """A relative path after the base's folder, without empty segments inside; a rooted path as it is. Then a fold over its segments:
    ``.`` adds nothing, ``..`` takes the last one (the root's too), and either at the end leaves a slash."""
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href_path)
    path_ = F.when(href_path.startswith("/"), href_path).otherwise(F.regexp_replace(joined, "/{2,}", "/"))
    return once(path_, lambda whole: F.when(~whole.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(once(F.split(whole, "/"), _folded)))


def _folded(segments: Column) -> Column:
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return once(F.concat(F.array_join(kept, "/"), tail), lambda out: F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out)))


def absolute_url(base: Column, href: Column) -> Column:
    """A link resolved against its page: other schemes and hosts as they are; else path (with dot segments removed), query and fragment
    by RFC 3986. A link with the page's own scheme but no host is relative. Spaces before it and line ends in it go; null stays null."""
    return once(_base(base), lambda b: _resolved(b, href))


def absolute_urls(base: Column, hrefs: Column) -> Column:
    """:func:`absolute_url` of each link of a page; the page's own address is taken apart once."""
    return once(_base(base), lambda b: F.transform(hrefs, lambda href: _resolved(b, href)))


def _base(url: Column) -> Column:
    scheme, root = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.struct(url.alias("url"), scheme.alias("scheme"), root.alias("root"), path(url).alias("path"), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1).alias("query"))


def _resolved(base: Column, href: Column) -> Column:
    href = F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")
    return once(href, lambda href: once(F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), lambda own: once(
        F.when(own != "", F.substring(href, F.length(own) + 2, F.length(href))).otherwise(href), lambda rest: (
            F.when((own != "") & ((own != base["scheme"]) | rest.startswith("//")), href)
            .when(rest.startswith("//"), F.concat(base["scheme"], F.lit(":"), rest))
            .when(rest == "", base["url"])
            .otherwise(once(F.regexp_extract(rest, r"^([^?#]*)", 1), lambda p: _joined(base, rest, p)))
        ))))


def _joined(base: Column, rest: Column, p: Column) -> Column:
    q, f = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(rest, r"(#.*)$", 1)
    own_page = F.concat(base["root"], base["path"], once(q, lambda q: F.when(q == "", base["query"]).otherwise(q)), f)
    return F.when(p == "", own_page).otherwise(F.concat(base["root"], _merged_path(base["path"], p), q, f))


def is_host_of(host: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of ``hosts`` or below one."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith(f".{h}")
    return out


def is_social_or_chat(url: Column) -> Column:
    host = F.regexp_replace(netloc(with_scheme(url)), r"^www\.", "")
    return F.coalesce((url != "") & is_host_of(host, SOCIAL_HOSTS), F.lit(False))


def company_website(url: Column) -> Column:
    """A URL with a scheme; null if it is a social or chat address."""
    return F.when((url != "") & ~is_social_or_chat(url), with_scheme(url))


def same_site_family(a: Column, b: Column) -> Column:
    """Equal hosts, or one below the other."""
    x, y = host_key(a), host_key(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def place_id(url: Column) -> Column:
    """The place id in a map URL: after ``!1s`` or after ``place_id:``."""
    found = [F.regexp_extract(url, p, 1) for p in (r"!1s([^!]+)", r"place_id[:=]([^&/?#]+)")]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def is_contact_path(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for hint in CONTACT_PATH_HINTS:
        out = out | low.contains(hint)
    return out
