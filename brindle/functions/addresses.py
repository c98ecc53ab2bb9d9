"""International addresses: every rule as an expression with its own error; only names beyond ASCII visit Python."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# Fixed values.
RESERVED_ENDS = ("arpa", "invalid", "local", "localhost", "onion", "test")
LABEL_KINDS = ("Ll", "Lo", "Lm", "Mn", "Mc", "Nd")
KEPT_LETTERS = "ßς"

_ATEXT = r"A-Za-z0-9!#$%&'*+/=?^_`{|}~\-"
_NAME = pa.struct([("local", pa.string()), ("ascii", pa.string()), ("domain", pa.string()), ("error", pa.string())])


def read_label(label: str) -> tuple[str, str]:
    """A label as ASCII and as letters. Case is folded and compatible forms are composed, but for two letters that names keep."""
    if label[:4].lower() == "xn--":
        shown = label[4:].lower().encode("ascii").decode("punycode")
        if shown.isascii() or read_label(shown) != (label.lower(), shown):
            raise ValueError(label)
        return label.lower(), shown
    folded = "".join(ch if ch in KEPT_LETTERS else ch.casefold() for ch in label)
    shown = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", folded).lower())
    if shown.isascii():
        return shown, shown
    if any(unicodedata.category(ch) not in LABEL_KINDS and ch != "-" for ch in shown) or unicodedata.category(shown[0])[0] == "M" or "-" in (shown[0], shown[-1]):
        raise ValueError(label)
    return "xn--" + shown.encode("punycode").decode("ascii"), shown


def _read(local: str | None, domain: str | None) -> dict:
    out = {"local": local and unicodedata.normalize("NFC", local), "ascii": None, "domain": None, "error": None}
    if local and any(unicodedata.category(ch)[0] in "ZC" for ch in local):
        return out | {"error": "The part before the @ holds an invisible character."}
    try:
        labels = [read_label(x) for x in domain.split(".")] if domain else []
    except (ValueError, UnicodeError):
        return out | {"error": "The domain holds a character that names do not allow."}
    return out | ({"ascii": ".".join(a for a, _ in labels), "domain": ".".join(s for _, s in labels)} if labels else {})


@F.arrow_udf(from_arrow_type(_NAME))
def _international(locals_: pa.Array, domains: pa.Array) -> pa.Array:
    return pa.array((_read(a.as_py(), d.as_py()) for a, d in zip(locals_, domains, strict=True)), type=_NAME)


def read_address(email: Column) -> Column:
    """struct(valid, normalized, local, domain, ascii_domain, error) of an address. Spaces around it go, the full stops of other scripts count as dots.

    Normalized is in lower case and composed, the domain in letters; ``ascii_domain`` is its form for look-ups. Of several faults the first is told,
    the local part's before the domain's; then all but ``error`` are null. Null is ``Email must be a string``. The order of letters in
    right-to-left names is not judged.
    """
    text = F.regexp_replace(F.regexp_replace(email, r"^[\s 　]+|[\s 　]+$", ""), "[。．｡]", ".")
    local, raw = F.regexp_extract(text, "^([^@]*)@", 1), F.regexp_extract(text, "@(.*)$", 1)
    strange = lambda x: x.rlike(r"[^\x00-\x7f]")
    named = strange(raw) | raw.rlike(r"(?i)(^|\.)xn--")
    # Broken dots or hyphens are told below; names are read only where each label has a character.
    whole = ~raw.rlike(r"^\.|\.$|\.\.") & (F.length(raw) <= 255) & (F.length(local) <= 64)
    name = _international(F.when(strange(local) & (F.length(local) <= 64), local), F.when(named & whole, raw))
    domain, ascii_ = F.coalesce(name["domain"], F.lower(raw)), F.coalesce(name["ascii"], F.lower(raw))
    shown = F.lower(F.coalesce(name["local"], local))
    total = F.length(shown) + F.length(ascii_) + 1
    rules = [
        (text.isNull(), "Email must be a string"),
        (text == "", "Email is empty"),
        (~text.rlike(r"(?U)^[^@\s]{1,64}@[^@\s]{1,255}$"), "Invalid email format"),
        (local.startswith('"'), "A quoted part before the @ is not allowed."),
        (local.startswith("."), "The address starts with a dot."),
        (local.endswith("."), "A dot stands right before the @."),
        (local.contains("..") | raw.contains(".."), "Two dots stand in a row."),
        (local.rlike(rf"[^{_ATEXT}.\u0080-\x{{10ffff}}]"), "The part before the @ holds an invalid character."),
        (raw.startswith("["), "A bracketed host is not allowed."),
        (raw.startswith("."), "A dot stands right after the @."),
        (raw.endswith("."), "The address ends with a dot."),
        (raw.rlike(r"[^A-Za-z0-9.\-\u0080-\x{10ffff}]"), "The domain holds a character that names do not allow."),
        (raw.startswith("-") | raw.endswith("-") | raw.rlike(r"\.-|-\."), "A label of the domain starts or ends with a hyphen."),
        (raw.rlike(r"(?i)(^|\.)(?!xn--)[^.]{2}--"), "Two hyphens stand third and fourth in a label."),
        (name["error"].isNotNull(), name["error"]),
        (ascii_.rlike(r"[^.]{64,}"), "A label of the domain has over 63 characters."),
        (F.length(ascii_) > 253, "The domain has over 253 characters."),
        (~ascii_.contains("."), "The domain has no dot."),
        (~ascii_.rlike(r"(?i)[a-z]$") & ~ascii_.rlike(r"(?i)(^|\.)xn--[^.]*$"), "The domain ends in no top-level name."),
        (ascii_.rlike(r"(^|\.)(" + "|".join(RESERVED_ENDS) + ")$"), "The domain is a reserved name."),
        (total > 254, "The address has over 254 characters."),
    ]
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message if isinstance(message, Column) else F.lit(message)).otherwise(error)
    fine = lambda x: F.when(error.isNull(), x)
    return F.struct(error.isNull().alias("valid"), fine(F.concat(shown, F.lit("@"), domain)).alias("normalized"), fine(shown).alias("local"), fine(domain).alias("domain"), fine(ascii_).alias("ascii_domain"), error.alias("error"))
