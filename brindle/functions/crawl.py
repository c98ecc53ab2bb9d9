"""Decisions on recorded crawl results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.contacts import PHONE_HINTS

# Fixed values.
CHALLENGE_HINTS = ("security verification", "verify you are human", "verify you're human", "verify you're not a robot", "verify you are not a robot", "attention required", "cf-chl", "recaptcha", "captcha", "access denied", "temporarily unavailable")
TRANSPORT_HINTS = (
    "proxy", "407", "proxy authentication", "tunnel connection failed", "socks", "tunneling", "connection reset by peer", "temporary failure in name resolution", "name or service not known",
    "network is unreachable", "no route to host", "econnreset", "connection aborted",
)
RETRY_HINTS = ("verify you're not a robot", "verify you are not a robot", "attention required", "please enable cookies", "cloudflare", "g-recaptcha-response")
BLOCKED_STATUS = (401, 403, 429, 503)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def challenge_page(status: Column, title: Column, body: Column) -> Column:
    """A blocking status, or a hint in the title and the first 4000 characters."""
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    return F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False)) | contains_any(head, CHALLENGE_HINTS)


def header_retry(status: Column, body: Column, hints: tuple[str, ...], already: Column) -> Column:
    """A 401 or 403 with a hint in its body, once."""
    return ~already & F.coalesce(status.isin(401, 403), F.lit(False)) & contains_any(body, hints)


def transport_error(message: Column, relay_host: Column) -> Column:
    """An error of the relay, not of the site: it names the relay's host or one of the hints."""
    named = F.coalesce((relay_host != "") & F.lower(message).contains(F.lower(relay_host)), F.lit(False))
    return named | contains_any(message, TRANSPORT_HINTS)


def phone_in_context(text: Column, start: Column, length: Column, hints: tuple[str, ...] = PHONE_HINTS) -> Column:
    """A hint within 40 characters before or after the place (from 0) of a number."""
    first = F.greatest(start - 40, F.lit(0))
    return contains_any(F.substring(text, first + 1, start + length + 40 - first), hints)


def messenger_digits(href: Column) -> Column:
    """All digits of a messenger link with a plus before them; null if it has none."""
    digits = F.regexp_replace(href, r"\D", "")
    return F.when(digits != "", F.concat(F.lit("+"), digits))


def escalate_site(crawl_status: Column, pages: Column, has_contacts: Column, blocked: Column, challenged: Column, shell: Column, redirected: Column) -> Column:
    """Whether a site needs a browser, from flags over its pages: none without pages unless it was blocked or failed, none
    with a contact; else a blocking status, a challenge or a script shell, then no foreign redirect, decide."""
    return (
        F.when(pages == 0, crawl_status.isin("blocked_by_robots", "failed")).when(has_contacts, False).when(blocked | challenged | shell, True)
        .when(redirected, False).otherwise(crawl_status.isin("blocked_by_robots", "robots_bypassed"))
    )


def next_status(status: Column) -> Column:
    """What queueing does to a run's company: a missing, failed or skipped one is queued anew, others stay."""
    return F.when(status.isNull() | status.isin("failed", "skipped"), "queued").otherwise(status)


def uses_today(uses: Column, last_reset: Column, now: Column, day_seconds: int = 86400) -> Column:
    """A daily counter that starts anew once a day has passed since its last reset."""
    return F.when(F.unix_timestamp(now) - F.unix_timestamp(last_reset) > day_seconds, 0).otherwise(uses)
