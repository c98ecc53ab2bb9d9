"""E-mail addresses, phone numbers and chat handles as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from brindle.functions.values import once

# Fixed values.
EMAIL = r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})"
PHONE = r"(?<!\w)(\+?\d[\d\s()./\-]{6,}\d)"
NOISE_EMAIL_DOMAINS = ("sentry.io", "sentry.wixpress.com", "sentry-next.wixpress.com", "myemail.com")
NOISE_EMAIL_LOCALS = ("johnsmith", "janedoe", "test", "example")
COMMON_MAILBOX_DOMAINS = ("gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "yahoo.com", "ymail.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com")
NOISE_PHONES = ("12345678", "123456789", "1234567890")
PHONE_HINTS = (
    "phone", "tel", "telephone", "mobile", "cell", "call", "contact", "whatsapp", "telegram", "hotline", "office", "reservation", "booking", "support",
    "telefone", "telefono", "teléfono", "movil", "móvil", "celular", "telefon", "telefonnummer", "numara", "контакт", "телефон", "тел",
    "โทร", "เบอร์", "มือถือ", "ติดต่อ", "电话", "電話", "手机", "手機", "联系",
)
ROLE_LOCALS = (
    "abuse", "admin", "administrator", "all", "billing", "contact", "contactus", "cs", "customercare", "customersupport", "customerservice", "devnull", "dns", "ftp",
    "hello", "help", "helpdesk", "hostmaster", "info", "information", "invoice", "it", "legal", "mailer-daemon", "marketing", "media", "news", "newsletter",
    "no-reply", "nobody", "noreply", "null", "operations", "orders", "postmaster", "press", "privacy", "recruiting", "recruitment", "refunds", "register",
    "registration", "reply", "root", "sales", "security", "service", "services", "spam", "sso", "subscribe", "support", "sysadmin", "tech", "techsupport",
    "test", "unsubscribe", "usenet", "uucp", "webmaster", "www",
)
# The seed list of throwaway domains; a full list is a table (see sources.blocklist).
DISPOSABLE_SEED = (
    "mailinator.com", "guerrillamail.com", "guerrillamail.net", "guerrillamail.org", "guerrillamail.de", "guerrillamail.info", "guerrillamailblock.com", "grr.la", "sharklasers.com", "spam4.me",
    "trashmail.com", "trashmail.at", "trashmail.io", "trashmail.me", "trashmail.net", "trashmail.org", "trashmail.xyz", "trashmailer.com", "10minutemail.com", "10minutemail.net",
    "10minutemail.org", "10minutemail.de", "10minutemail.co.za", "10minutemail.ru", "tempmail.com", "tempmail.net", "tempmail.org", "temp-mail.org", "temp-mail.io", "tempmail.de",
    "tempinbox.com", "tempr.email", "throwam.com", "throwam.net", "throwaway.email", "dispostable.com", "discard.email", "discardmail.com", "discardmail.de", "spamgourmet.com",
    "spamgourmet.net", "spamgourmet.org", "spamoff.de", "spamspot.com", "yopmail.com", "yopmail.fr", "yopmail.net", "cool.fr.nf", "jetable.fr.nf", "nospam.ze.tc", "nomail.xl.cx", "mega.zik.dj",
    "speed.1s.fr", "courriel.fr.nf", "moncourrier.fr.nf", "monemail.fr.nf", "monmail.fr.nf", "jetable.net", "jetable.org", "mailnull.com", "maildrop.cc", "mailnew.com", "mailcatch.com",
    "mailnesia.com", "mailexpire.com", "mailme.lv", "mailme24.com", "mailmetrash.com", "mailmoat.com", "mailscrap.com", "mailseal.de", "mailtemp.info", "mailtome.de", "mailtothis.com",
    "mailzilla.com", "spamfree24.org", "spamfree24.de", "spamfree24.eu", "spamfree24.info", "spamfree24.net", "spamfree.eu", "spamgob.com", "spamhereplease.com", "spamhole.com", "spamify.com",
    "spamkill.info", "spaml.com", "spaml.de", "spammotel.com", "spammotels.com", "spammy.host", "spamok.com", "spampa.com", "spamslicer.com", "spamstack.net", "spamthis.co.uk",
    "spamthisplease.com", "spamtrail.com", "spamtroll.net", "spamwc.de", "spamwc.cf", "spamwc.ga", "spamwc.gq", "fakeinbox.com", "fake-box.com", "fakedemail.com", "fakemailz.com",
    "fakeemails.com", "getnada.com", "getnada.me", "getairmail.com", "getonemail.com", "disposableaddress.com", "disposableemailaddresses.com", "disposableemailaddresses.emailmiser.com",
    "dispomail.eu", "dodgit.com", "dodgit.org", "dontreg.com", "dontsendmespam.de", "drdrb.com", "drdrb.net", "dumpmail.de", "dumpyemail.com", "e4ward.com", "easytrashmail.com", "einrot.com",
    "emailgo.de", "emailias.com", "emaillime.com", "emailmiser.com", "emailsensei.com", "emailtemporanea.com", "emailtemporanea.net", "emailtemporanea.org", "emailthe.net", "emailtmp.com",
    "emailwarden.com", "emailx.at.hm", "emailxfer.com", "emz.net", "enterto.com", "ephemail.net", "etranquil.com", "etranquil.net", "etranquil.org", "evopo.com", "explodemail.com",
    "eyepaste.com", "f4k.es", "fast-email.com", "fast-mail.fr", "fastem.com", "fastemail.us", "fastemailer.com", "faster-email.com", "fastimap.com", "fastmazda.com", "fastmessaging.com",
    "fastsfwmail.com", "fastswift.com", "fastyandex.com", "fightallspam.com", "fiifke.de", "filzmail.com", "fixmail.tk", "fizmail.com", "fleckens.hu", "flurred.com", "flyspam.com",
    "frapmail.com", "friendlymail.co.uk", "front14.org", "fudgerub.com", "fun2.biz", "furzauflunge.de", "fux0ringduh.com", "fw2.me", "getmails.eu", "getnowtoday.cf", "gishpuppy.com",
    "gmailom.co", "goemailgo.com", "gotmail.com", "gotmail.net", "gotmail.org", "anonaddy.com", "anonaddy.me", "33mail.com", "guerrillamail.biz", "spam.la", "binkmail.com", "bob.email",
    "bofthew.com", "boun.cr", "bouncr.com", "breakthru.com", "brefmail.com", "brn.ee", "bspamfree.org", "bugmenot.com", "bumpymail.com",
)
POPULAR_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.in", "yahoo.com.br", "yahoo.com.ar", "yahoo.com.mx", "yahoo.com.au", "yahoo.fr", "yahoo.de", "yahoo.it", "yahoo.es",
    "hotmail.com", "hotmail.co.uk", "hotmail.fr", "hotmail.de", "hotmail.it", "hotmail.es", "hotmail.com.br", "outlook.com", "live.com", "live.co.uk", "live.fr", "live.de", "msn.com",
    "icloud.com", "me.com", "mac.com", "aol.com", "protonmail.com", "protonmail.ch", "proton.me", "pm.me", "zoho.com", "fastmail.com", "fastmail.fm", "hey.com", "tutanota.com", "tutamail.com",
    "tuta.io", "gmx.com", "gmx.de", "gmx.net", "web.de", "mail.ru", "yandex.com", "yandex.ru", "rambler.ru", "inbox.com", "inbox.lv", "rediffmail.com", "comcast.net", "verizon.net", "att.net",
    "sbcglobal.net", "bellsouth.net", "cox.net", "charter.net", "earthlink.net", "optonline.net",
)


def extract_emails(text: Column) -> Column:
    """Sorted distinct addresses of a text, in lower case."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(EMAIL), 1)))


def email_parts(email: Column) -> tuple[Column, Column]:
    low = F.lower(F.btrim(email))
    return F.substring_index(low, "@", 1), F.when(low.contains("@"), F.regexp_extract(low, "^[^@]*@(.*)$", 1)).otherwise(F.lit(""))


def is_noise_email(email: Column) -> Column:
    low = F.lower(F.btrim(email))
    out = F.substring_index(low, "@", 1).isin(*NOISE_EMAIL_LOCALS)
    for d in NOISE_EMAIL_DOMAINS:
        out = out | low.endswith(f"@{d}")
    return out


def is_asset_candidate(email: Column, page_host: Column) -> Column:
    """An address in a page's script or style counts if its domain is the site's or a common mailbox."""
    domain = email_parts(email)[1]
    host = F.regexp_replace(F.lower(page_host), r"^www\.", "")
    related = (domain == host) | domain.endswith(F.concat(F.lit("."), host)) | host.endswith(F.concat(F.lit("."), domain))
    return (domain != "") & (related | domain.isin(*COMMON_MAILBOX_DOMAINS))


def email_syntax_ok(email: Column) -> Column:
    """The documented subset of address syntax: one @, a dotted local part of at most 64, a domain with a letter TLD."""
    low = F.lower(F.btrim(email))
    local = F.substring_index(low, "@", 1)
    ok = low.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$")
    return F.coalesce(ok & (F.length(local) <= 64) & (F.length(low) <= 254), F.lit(False))


def phone_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), 1)


def normalize_phone(value: Column) -> Column:
    """A number as ``+digits``: guards first (URL, over three letters, over 64 characters, a time), then 9 to 15 digits.

    The length is tested before a leading ``00`` is dropped.
    """
    return once(F.btrim(F.regexp_replace(value, r"(?i)(ext|extension|x)\s*\d+$", "")), lambda c: once(F.regexp_replace(c, r"\D", ""), lambda digits: _dialled(c, digits)))


def _dialled(c: Column, digits: Column) -> Column:
    """The length goes first: most texts have too few digits, and need no other test."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    bad = c.contains("://") | F.lower(c).contains("www.") | (letters > 3) | (F.length(c) > 64) | c.rlike(r"\b\d{1,2}[.:]\d{2}\b")
    return F.when(F.length(digits).between(9, 15) & ~bad, F.concat(F.lit("+"), F.regexp_replace(digits, "^00", "")))


def is_noise_phone(phone: Column) -> Column:
    """One digit repeated, or a counting row."""
    one = lambda digits: (digits != "") & (F.replace(digits, F.substring(digits, 1, 1), F.lit("")) == "")
    return once(F.regexp_replace(phone, r"\D", ""), lambda digits: one(digits) | digits.isin(*NOISE_PHONES))


def has_phone_hint(context: Column) -> Column:
    low = F.lower(context)
    out = F.lit(False)
    for hint in PHONE_HINTS:
        out = out | low.contains(hint)
    return out


def verifier_phone(phone: Column) -> Column:
    """Digits and plus signs, with one leading plus added if there is none."""
    kept = F.regexp_replace(phone, r"[^\d+]", "")
    return F.when(kept.startswith("+"), kept).otherwise(F.concat(F.lit("+"), kept))


def telegram_handle(value: Column) -> Column:
    c = F.btrim(value)
    last = F.regexp_extract(c, r"://[^/?#]+/(?:[^?#]*/)?([^/?#]+)/*(?:[?#].*)?$", 1)
    linked = F.lower(c).rlike(r"(t\.me|telegram\.me|telegram\.dog)")
    return F.when(linked & (last != ""), F.concat(F.lit("@"), F.regexp_replace(F.lower(last), "^@+", ""))).when(c.startswith("@"), F.concat(F.lit("@"), F.lower(F.substring(c, 2, 1 << 30))))


def tag_values(value: Column) -> Column:
    """Parts between ``;`` and ``|``, trimmed, without blanks."""
    return F.filter(F.transform(F.split(value, r"[;|]"), lambda x: F.btrim(x)), lambda x: x != "")


def role_or_disposable(email: Column) -> tuple[Column, Column]:
    """(is_role_based, is_disposable by the seed list)."""
    local, domain = email_parts(email)
    return local.isin(*ROLE_LOCALS), domain.isin(*DISPOSABLE_SEED)


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours."""
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, two[j - 2] + 1)
            row[j] = best
        two, one = one, row
    return one[len(b)]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")
