"""Columns out of HTML that a pattern can read, in the JVM; `markup` reads whole pages."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from brindle.functions import contacts, crawl
from brindle.functions.values import in_slices, once

CAPTCHA_HINTS = ("captcha", "g-recaptcha", "hcaptcha", "cf-turnstile")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&eacute;": "é", "&#64;": "@", "&#46;": ".", "&#x40;": "@", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Named entities of common use, and ``&amp;`` last."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title(html: Column) -> Column:
    found = F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(found != "", found)


def assets(html: Column) -> Column:
    """src of scripts and href of stylesheet links."""
    return F.concat(
        F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""), 1),
        F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1),
    )


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)


def json_ld_values(block: Column, key: str) -> Column:
    """String values of a key at any depth of a JSON-LD block; an invalid block gives none."""
    values = F.regexp_extract_all(block, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\\\]|\\\\.)*)"'), 1)
    return F.when(F.try_parse_json(block).isNotNull(), values).otherwise(F.array().cast("array<string>"))


def _leaves(block: str | None) -> list[dict]:
    try:
        todo = [json.loads(block)] if block else []
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append({"kind": "text", "value": node})
        elif isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            for key, value in node.items():
                low = key.lower()
                if low in ("email", "telephone") and isinstance(value, str):
                    out.append({"kind": low, "value": value})
                elif low == "sameas":
                    out.extend({"kind": low, "value": v} for v in (value if isinstance(value, list) else [value]) if isinstance(v, str))
                else:
                    todo.append(value)
    return out


_LEAVES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


@F.arrow_udf(from_arrow_type(_LEAVES))
def json_ld_leaves(blocks: pa.Array) -> pa.Array:
    """String leaves of a page's JSON-LD blocks at any depth, in no order: email, telephone and sameAs by their key, all
    others as text. Broken blocks have none."""
    return in_slices(blocks, lambda bs: [] if bs is None else [x for b in bs for x in _leaves(b)], _LEAVES)


def structured_contacts(leaves: Column) -> dict[str, Column]:
    """Sorted emails, phones, telegram and whatsapp handles in leaves of a page's JSON-LD: addresses in e-mail and text leaves,
    numbers that are a whole telephone or text leaf (as written), handles of sameAs links."""
    of = lambda *kinds: F.transform(F.filter(leaves, lambda x: x["kind"].isin(*kinds)), lambda x: x["value"])
    tidy = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull())))
    emails = F.flatten(F.transform(of("email", "text"), lambda v: contacts.extract_emails(v)))
    phone = lambda v: once(contacts.normalize_phone(v), lambda n: F.coalesce(n.isNotNull() & ~contacts.is_noise_phone(n), F.lit(False)))
    chat = lambda v: v.contains("wa.me") | v.contains("whatsapp")
    return {
        "emails": tidy(F.filter(emails, lambda e: ~contacts.is_noise_email(e))), "phones": tidy(F.transform(F.filter(of("telephone", "text"), phone), lambda v: F.btrim(v))),
        "telegram": tidy(F.transform(of("sameas"), lambda v: contacts.telegram_handle(v))), "whatsapp": tidy(F.transform(F.filter(of("sameas"), chat), lambda v: crawl.messenger_digits(v))),
    }


def decode_protected_email(code: Column) -> Column:
    """An address hidden as hex bytes, each combined with the first by exclusive or."""
    byte = lambda k: F.conv(F.substring(code, k, 2), 16, 10).cast("int")
    n = (F.length(code) / 2).cast("int")
    chars = F.transform(F.sequence(F.lit(2), n), lambda k: F.char(byte(2 * k - 1).bitwiseXOR(byte(F.lit(1)))))
    return F.when((n >= 2) & code.rlike("^([0-9A-Fa-f]{2})+$"), F.array_join(chars, ""))


def useless_page(status: Column, text_length: Column, has_contact: Column, has_social: Column, threshold: int = 160) -> Column:
    """A page without contacts that failed or has little text."""
    return F.when(has_contact, False).when(has_social & (text_length >= threshold), False).when(status.isNull() | (status >= 400), True).otherwise(text_length < threshold)


def script_shell(html: Column, text_length: Column) -> Column:
    """Little visible text, and the marks of a page that a script fills."""
    return (text_length < 300) & (html.rlike(r"""(?i)id\s*=\s*["'](root|app|__next|__nuxt)["']""") | (F.size(assets(html)) > 0))
