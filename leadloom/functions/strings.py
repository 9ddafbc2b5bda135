"""Text functions as column expressions: phones, e-mails, names, caps, labels, commands."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that includes the no-break space, which Java's \s leaves out.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with `c` worked out once a row however often the body reads it: a plain expression would be repeated at every use."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def tidy(c: Column, limit: int = 240, mark: str = "…") -> Column:
    """Squeezed text of at most `limit` characters; longer text ends in the mark."""
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit(mark))).otherwise(text)


def clip(c: Column, limit: int, mark: str = ".") -> Column:
    """As tidy, but blanks before the mark go."""
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit(mark))).otherwise(text)


def clip_reason(c: Column, limit: int = 110) -> Column:
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def phone(c: Column) -> Column:
    """E.164 of the first number of a list, for ten-digit national numbers; null when in doubt."""
    digits = F.regexp_replace(F.split(c, "[;,/]")[0], r"\D", "")
    n = F.length(digits)
    national = (
        F.when(digits.startswith("0091"), F.substring(digits, 5, 100))
        .when(digits.startswith("91") & (n >= 12), F.substring(digits, 3, 100))
        .when(digits.startswith("0") & (n == 11), F.substring(digits, 2, 100))
        .otherwise(digits)
    )
    return F.when(national.rlike("^[1-9][0-9]{9}$"), F.concat(F.lit("+91"), national))


def email(c: Column) -> Column:
    """The first part with an @, in lower case, if it has the shape of an address."""
    parts = F.filter(F.split(c, r"[;,\s]+"), lambda x: x.contains("@"))
    address = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), "^mailto:", "")
    return F.when(address.rlike(r"^[^@\s]+@[^@\s.]+\.[^@\s]+$"), address)


def website(c: Column) -> Column:
    """A web address with a dotted host; https where no scheme is given, without one final slash."""
    first = F.trim(F.split(c, r"[;\s]+")[0])
    full = F.when(first.rlike("(?i)^https?://"), first).otherwise(F.concat(F.lit("https://"), first))
    host = F.lower(F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rest = F.regexp_extract(full, r"(?i)^https?://[^/?#]*(.*)$", 1)
    scheme = F.lower(F.regexp_extract(full, r"(?i)^(https?://)", 1))
    port = F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+(:\d+)", 1)
    return F.when((first != "") & host.contains("."), F.regexp_replace(F.concat(scheme, host, port, rest), "/$", ""))


@F.pandas_udf(T.StringType())
def decompose(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no expression for it."""
    fold = lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f")
    return s.map(fold)


#: Words that do not tell businesses apart.
BUSINESS_WORDS = ("pvt", "private", "ltd", "limited", "llp", "inc", "co", "company", "the", "and", "restaurant", "hotel", "store", "stores")


def name_key(c: Column, decomposed: bool = True) -> Column:
    """Comparison key of a business name. Without `decomposed` accents count as separators, and no Python runs."""
    text = F.lower(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(decompose(text) if decomposed else text, "&", " and ")
    text = F.regexp_replace(text, "[^a-z0-9]+", " ")
    text = F.regexp_replace(text, rf"\b({'|'.join(BUSINESS_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def city_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def segment_label(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("other")), F.lit("_"), F.lit(" "))


def join_nonblank(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *(blank_to_null(p) for p in parts))


def map_address(tags: Column) -> Column:
    """House number and street, suburb, city, postcode of a tag map, comma-joined; null when none is there."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    street = join_nonblank(" ", tag("addr:housenumber"), tag("addr:street"))
    return blank_to_null(join_nonblank(", ", street, tag("addr:suburb"), tag("addr:city"), tag("addr:postcode")))


def split_title(c: Column) -> tuple[Column, Column]:
    """Headline and publication, parted at the last ' - '."""
    publication = F.when(c.contains(" - "), F.substring_index(c, " - ", -1))
    headline = F.when(publication.isNull(), c).otherwise(F.left(c, F.length(c) - F.length(publication) - 3))
    return F.trim(headline), F.trim(publication)


def multiline(c: Column, limit: int) -> Column:
    """Lines squeezed, empty ones dropped, the whole capped."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), squeeze), lambda x: x != "")
    return F.substring(F.array_join(lines, "\n"), 1, limit)


def csv_cell(c: Column) -> Column:
    """Quoted only where the cell holds a quote, a comma or a line break."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def html_escape(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda text, p: F.replace(text, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(c, F.lit("")))


def storage_safe(c: Column) -> Column:
    """Without NUL; strings in the JVM's UTF-8 hold no lone surrogates."""
    return F.replace(c, F.lit("\u0000"), F.lit(""))


def redact_key(c: Column) -> Column:
    return F.regexp_replace(c, "(api-key=)[^&]*", "$1***")


def contact_line(phone: Column, email: Column, website: Column, missing: str = "no contact listed") -> Column:
    bare = F.regexp_replace(website, "^https?://(www\\.)?", "")
    return F.coalesce(blank_to_null(phone), blank_to_null(email), blank_to_null(bare), F.lit(missing))


def lower_first(c: Column) -> Column:
    """First letter lowered unless the first word has two capitals in a row or a digit; no final dot."""
    text = F.regexp_replace(F.trim(c), r"\.$", "")
    keep = F.regexp_extract(text, r"^(\S*)", 1).rlike("[A-Z]{2,}|[0-9]")
    return F.when(keep, text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000)))


#: The status commands of the owner's messages, by section letter.
STATUSES = ("new", "contacted", "quoted", "won", "lost", "ignored")


def command(c: Column) -> Column:
    """struct(label, status, note) of messages such as 'L3 won note', else null."""
    pattern = rf"(?is)^\s*([RLG])\s*(\d+)\s+({'|'.join(STATUSES)})\b\s*(.*)$"
    label = F.concat(F.upper(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2))
    return F.when(c.rlike(pattern), F.struct(label.alias("label"), F.lower(F.regexp_extract(c, pattern, 3)).alias("status"), F.trim(F.regexp_extract(c, pattern, 4)).alias("note")))


def order_command(c: Column) -> Column:
    """The details, at most 1,500 characters, of a message that starts with 'order'."""
    pattern = r"(?is)^\s*order\b[\s:,-]*(.*)$"
    return F.when(c.rlike(pattern), F.substring(F.regexp_extract(c, pattern, 1), 1, 1500))


def same_number(a: Column, b: Column) -> Column:
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return (digits(a) != "") & (digits(a) == digits(b))


def matches_query(name: Column, requirement: Column, phone: Column, query: str) -> Column:
    """Free text in name or requirement, or four digits and more in the phone's digits; an empty query matches."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lower(F.coalesce(name, F.lit(""))).contains(q) | F.lower(F.coalesce(requirement, F.lit(""))).contains(q)
    digits = "".join(c for c in q if c in "0123456789")
    return hit | F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "").contains(digits) if len(digits) >= 4 else hit


def decoded_article_url(c: Column) -> Column:
    """The first web address inside a base64url article id."""
    raw = F.decode(F.unbase64(F.translate(c, "-_", "+/")), "ISO-8859-1")
    return blank_to_null(F.regexp_extract(raw, r"(https?://[\x21-\x7e]+)", 1))


#: Roles of receipts by exact type, then by prefix; all else is the auditor's.
ROLE_BY_TYPE = {
    "run.created": "auditor",
    "evidence.sealed": "auditor",
    "leads.upserted": "desk",
    "lead.status_changed": "owner",
    "lead.won": "desk",
    "openings.not_a_requirement": "verifier",
    "openings.no_site": "verifier",
    "openings.contact_search": "verifier",
    "openings.upgraded": "verifier",
}
ROLE_BY_PREFIX = (("source.", "scout"), ("openings.", "scout"), ("llm.", "reader"), ("digest.", "desk"), ("order.", "desk"), ("whatsapp.", "owner"), ("owner.", "owner"))


def receipt_role(c: Column) -> Column:
    cases = [(c == t, r) for t, r in ROLE_BY_TYPE.items()] + [(c.startswith(p), r) for p, r in ROLE_BY_PREFIX]
    return F.coalesce(*(F.when(test, F.lit(role)) for test, role in cases), F.lit("auditor"))
