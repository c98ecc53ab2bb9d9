"""Pages read by a tokenizer: one pass over Arrow batches gives a page's parts, all later rules are column expressions.

The pass knows quoted attributes (a ``>`` in them ends nothing), comments, raw text (script, style, title, textarea) and every named
and numeric entity. It reads each character a bounded number of times, so very long pages cost their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StringType

from brindle.functions import contacts, urls
from brindle.functions.html import CAPTCHA_HINTS, decode_protected_email
from brindle.functions.values import in_slices, once

RAW_TEXT = ("script", "style", "textarea", "title")
HIDDEN = ("noscript", "template")
FIELDS = ("input", "textarea", "select")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}

Token = tuple[str, str, dict[str, str]]


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the place behind the tag's ``>``; -1 if the tag never ends. The first of equal names counts."""
    out: dict[str, str] = {}
    while found := _ATTRIBUTE.match(text, at):
        at, value = found.end(), ""
        if found[2]:
            quote = text[at : at + 1]
            if quote in ("'", '"'):
                end = text.find(quote, at + 1)
                if end < 0:
                    return out, -1
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        out.setdefault(found[1].lower(), entities.unescape(value))
    end = text.find(">", at)
    return out, end + 1 if end >= 0 else -1


def tokens(text: str) -> Iterator[Token]:
    """(kind, name or data, attributes) with kinds text, start, end and raw (data of a raw-text element, after its start).
    A comment, tag or raw text that never ends takes the rest of the page; the rest of an unfinished tag is dropped."""
    at, held = 0, []
    while at < len(text):
        mark = text.find("<", at)
        if mark < 0:
            break
        held.append(text[at:mark])
        after = text[mark + 1 : mark + 2]
        name = _NAME.match(text, mark + (2 if after == "/" else 1))
        if not name and after not in ("!", "?", "/"):
            held.append("<")
            at = mark + 1
            continue
        if data := "".join(held):
            yield "text", data, {}
        held = []
        if not name:
            close = "-->" if text.startswith("<!--", mark) else ">"
            end = text.find(close, mark + 2)
            at = end + len(close) if end >= 0 else len(text)
            continue
        at = name.end()
        attributes, at = ({}, at + 1) if text.startswith(">", at) else _attributes(text, at)
        if at < 0:
            return
        low = name[0].lower()
        if after == "/":
            yield "end", low, {}
            continue
        yield "start", low, attributes
        if low in _RAW_END:
            end = _RAW_END[low].search(text, at)
            stop = end.start() if end else len(text)
            yield "raw", text[at:stop], {}
            at = stop
    if data := "".join([*held, text[at:]]):
        yield "text", data, {}


def note_asset(name: str, attributes: dict[str, str], scripts: list[str], sheets: list[str]) -> None:
    """Adds the asset of a start tag, if it has one, to its list."""
    if name == "script" and "src" in attributes:
        scripts.append(attributes["src"])
    elif name == "link" and "href" in attributes and any(r in attributes.get("rel", "").lower() for r in ("stylesheet", "preload")):
        sheets.append(attributes["href"])


def read_assets(text: str | None) -> list[str] | None:
    """The assets of :func:`read_page` alone."""
    if text is None:
        return None
    scripts, sheets = [], []
    for kind, data, attributes in tokens(text):
        if kind == "start":
            note_asset(data, attributes, scripts, sheets)
    return scripts + sheets


def read_page(text: str | None) -> dict | None:
    """The parts of one page; null for null."""
    if text is None:
        return None
    titles, words, links, scripts, sheets, forms, codes, blocks = [], [], [], [], [], [], [], []
    open_forms, anchor, hidden, last = [], None, 0, ("", {})

    def hint(data: str) -> None:
        if open_forms and any(h in data.lower() for h in CAPTCHA_HINTS):
            for form in open_forms:
                form["has_captcha"] = True

    def say(data: str) -> None:
        if not hidden and (word := entities.unescape(data).strip()):
            words.append(word)
            if anchor is not None:
                anchor["text"].append(word)

    for kind, data, attributes in tokens(text):
        if kind == "text":
            hint(data)
            say(data)
        elif kind == "raw":
            hint(data)
            name, last_attributes = last
            if name == "title":
                titles.append(entities.unescape(data))
                say(data)
            elif name == "textarea":
                say(data)
            elif name == "script" and "ld+json" in last_attributes.get("type", "").lower():
                blocks.append(data)
        elif kind == "end":
            if data in HIDDEN:
                hidden = max(0, hidden - 1)
            elif data == "a":
                anchor = None
            elif data == "form" and open_forms:
                open_forms.pop()
        else:
            last = (data, attributes)
            hidden += data in HIDDEN
            if data == "form":
                form = {"action": attributes.get("action", ""), "method": attributes.get("method", "").lower() or "get", "has_captcha": False, "fields": []}
                forms.append(form)
                open_forms.append(form)
            elif data in FIELDS:
                field = {"name": attributes.get("name"), "type": attributes.get("type", data).lower(), "placeholder": attributes.get("placeholder"), "required": "required" in attributes, "value": attributes.get("value")}
                for form in open_forms:
                    form["fields"].append(field)
            elif data == "a":
                anchor = {"href": attributes["href"], "text": [], "hidden": hidden > 0} if "href" in attributes else None
                if anchor is not None:
                    links.append(anchor)
            else:
                note_asset(data, attributes, scripts, sheets)
            if data in ("a", "span") and not hidden and "__cf_email__" in attributes.get("class", "").split():
                codes.append(attributes.get("data-cfemail", ""))
            hint(" ".join([data, *attributes, *attributes.values()]))
    title = " ".join(titles[0].split()) if titles else ""
    for link in links:
        link["text"] = " ".join(link["text"])
    return {"title": title or None, "text": " ".join(words), "links": links, "assets": scripts + sheets, "forms": forms, "protected": codes, "json_ld": blocks}


_S = pa.string()
_FIELD = pa.struct([("name", _S), ("type", _S), ("placeholder", _S), ("required", pa.bool_()), ("value", _S)])
_PARTS = pa.struct([
    ("title", _S), ("text", _S), ("links", pa.list_(pa.struct([("href", _S), ("text", _S), ("hidden", pa.bool_())]))), ("assets", pa.list_(_S)),
    ("forms", pa.list_(pa.struct([("action", _S), ("method", _S), ("has_captcha", pa.bool_()), ("fields", pa.list_(_FIELD))]))), ("protected", pa.list_(_S)), ("json_ld", pa.list_(_S)),
])
PARTS = from_arrow_type(_PARTS)


@F.arrow_udf(PARTS)
def page_parts(pages: pa.Array) -> pa.Array:
    """title (first, spaces collapsed; null if empty), visible text, anchors (``hidden`` inside noscript or template), assets (scripts,
    then style sheets and preloads), forms with all fields, codes of protected addresses, JSON-LD blocks. Null for null; an empty page has empty parts."""
    return in_slices(pages, read_page, _PARTS)


@F.arrow_udf(ArrayType(StringType()))
def page_assets(pages: pa.Array) -> pa.Array:
    """The assets of :func:`page_parts` alone, for rules that read no other part."""
    return in_slices(pages, read_assets, pa.list_(_S))


@F.arrow_udf(StringType())
def unescape_all(texts: pa.Array) -> pa.Array:
    """Named and numeric entities of the whole table as characters."""
    return pa.array((None if (t := x.as_py()) is None else entities.unescape(t) for x in texts), type=pa.string())


def page_emails(parts: Column) -> Column:
    """Sorted distinct addresses a visitor can see: in the text, in texts and mailto targets of anchors, and protected ones; noise goes."""
    shown = F.filter(parts["links"], lambda a: ~a["hidden"])
    mailto = F.filter(shown, lambda a: F.lower(F.btrim(a["href"])).startswith("mailto:"))
    found = F.concat(
        contacts.extract_emails(parts["text"]), F.flatten(F.transform(shown, lambda a: contacts.extract_emails(a["text"]))), F.flatten(F.transform(mailto, lambda a: contacts.extract_emails(a["href"]))),
        F.filter(F.transform(parts["protected"], lambda p: F.lower(decode_protected_email(p))), lambda e: e.isNotNull()),
    )
    return F.array_sort(F.filter(F.array_distinct(found), lambda e: ~contacts.is_noise_email(e)))


def first_assets(page_url: Column, parts: Column, most: int = 4) -> Column:
    """The first ``most`` distinct assets on the page's own host (``www.`` aside) with a known ending, as absolute URLs."""
    host = lambda u: F.regexp_replace(urls.netloc(u), r"^www\.", "")
    known = lambda u: F.lower(urls.path(u)).rlike(r"\.(" + "|".join(e[1:] for e in urls.ASSET_EXTENSIONS) + ")$")
    absolute = urls.absolute_urls(page_url, F.filter(parts["assets"], lambda a: a != ""))
    ours = once(host(page_url), lambda own: F.filter(absolute, lambda u: (own != "") & (host(u) == own) & known(u)))
    return F.slice(F.array_distinct(ours), 1, most)
