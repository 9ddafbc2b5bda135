"""Contacts in free text: phones, e-mails with their disguises, names of persons. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import strings

#: A text falls into stretches that may be numbers; all other characters and wide gaps part them. A stretch with an
#: underscore is a code, and what is shaped like a date is blanked out before.
PHONE_PARTS = r"[^0-9_ \t.()+-]+|[ \t]{2,}"
#: Digits with neither a blank, dot or dash between them nor a zero or the country's code before them.
BARE_RUN = r"^(?!\+91)[(+]*[1-9][0-9()+]*$"
#: Shapes of dates.
DATES = r"\b[0-9]{1,2}[.-][0-9]{1,2}[.-](?:[0-9]{4}|[0-9]{2})\b|\b[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}\b"
#: Addresses are words of these characters that hold one @; a disguised dot is one of them until the end.
DISGUISED_DOT = "\u0001"
ADDRESS_PARTS = f"[^A-Za-z0-9@._%+{DISGUISED_DOT}-]+"
#: How a dot and an at sign are written out.
DOT_WORDS = r"\s*[\[({]\s*(?:dot|DOT)\s*[\])}]\s*|\s+(?:dot|DOT)\s+"
AT_WORDS = r"(?:\s*[\[({]\s*(?:at|AT)\s*[\])}]\s*|\s+(?:at|AT)\s+)([A-Za-z0-9-]+" + DISGUISED_DOT + ")"
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
#: Help desks of procurement portals are nobody's contact.
PORTAL_DESKS = ("eproc", "cppp-nic", "cpppnic", "support-eproc", "supporteproc", "eprochelpdesk", "helpdesk", "support")
PORTAL_HOSTS = ("nic.in", "gov.in", "gem.gov.in")
PORTALS = tuple(f"{desk}@{host}" for desk in PORTAL_DESKS for host in PORTAL_HOSTS)

#: Labels that a person's name follows, and posts that one precedes.
NAME_LABELS = ("contact person", "contact officer", "nodal officer", "officer in charge", "name of contact", "name of the contact")
POSTS = ("registrar", "deputy registrar", "assistant registrar", "joint registrar", "store officer", "purchase officer", "warden", "superintendent", "mess manager", "general manager", "director")
#: Words of labels, posts and fields make no name.
FIELD_WORDS = ("page", "phone", "mobile", "tel", "email", "fax", "address", "website", "date", "time", "tender", "notice", "details", "department")
NOT_NAMES = tuple(sorted({w for phrase in (*NAME_LABELS, *POSTS, *FIELD_WORDS) for w in phrase.split()}))


def looks_like_phone(raw: Column, number: Column) -> Column:
    """A number that is written as one, or lies in the mobile range: a bare run of digits may be any reference number."""
    return number.isNotNull() & (~raw.rlike(BARE_RUN) | number.rlike(r"^\+91[6-9]"))


def find_phones(c: Column) -> Column:
    """Distinct E.164 numbers in order."""
    parts = F.split(F.regexp_replace(c, DATES, "|"), PHONE_PARTS)
    raw = F.transform(F.filter(parts, lambda p: F.length(p).between(10, 40) & ~p.contains("_")), lambda p: F.regexp_replace(p, r"^[ \t.)-]+|[ \t.(+-]+$", ""))
    read = F.transform(raw, lambda r: F.struct(r.alias("raw"), strings.phone(r).alias("number")))
    return F.array_distinct(F.transform(F.filter(read, lambda p: looks_like_phone(p["raw"], p["number"])), lambda p: p["number"]))


def find_emails(c: Column) -> Column:
    """Distinct addresses in order, plain ones and those written as 'name at host dot end', without the portals' help desks."""
    text = F.coalesce(c, F.lit(""))
    dotted = F.regexp_replace(text, DOT_WORDS, DISGUISED_DOT)
    text = F.when(text.rlike(DOT_WORDS), F.regexp_replace(dotted, AT_WORDS, "@$1")).otherwise(text)
    words = F.filter(F.split(text, ADDRESS_PARTS), lambda w: w.contains("@"))
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(F.replace(w, F.lit(DISGUISED_DOT), F.lit(".")), r"^[.@%+-]+|[.@%+_-]+$", "")))
    return F.array_distinct(F.filter(plain, lambda e: e.rlike(ADDRESS) & ~e.isin(*PORTALS)))


def looks_like_person(name: Column) -> Column:
    """Two capitalised words or more, all of them capitalised or initials, none a word of labels, posts or fields."""
    words = F.split(name, r"\s+")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}.'-]*$") & ~F.regexp_replace(F.lower(w), "[.]", "").isin(*NOT_NAMES))


def find_contact_name(c: Column) -> Column:
    """A labelled name, else the name before a post; null unless it looks like a person's."""
    spaced = lambda phrases: "|".join(p.replace(" ", r"\s+") for p in phrases)
    labelled = rf"(?i)\b(?:{spaced(NAME_LABELS)})\s*[:-]\s*([^\n;|,(0-9]{{3,80}})"
    before_post = rf"(?i)([^\n,;:]{{3,60}}),\s*(?:{spaced(POSTS)})\b"
    field = rf"(?i)\b(?:{spaced(FIELD_WORDS)})\b|\s{{2,}}"
    trimmed = lambda n: F.trim(n, F.lit(" .:-"))
    of_label = F.transform(F.regexp_extract_all(c, F.lit(labelled), F.lit(1)), lambda n: trimmed(F.get(F.split(n, field), F.lit(0))))
    # the post alone, sought from its comma, is much cheaper than with the words before it
    of_post = F.when(c.rlike(rf"(?i),\s*(?:{spaced(POSTS)})\b"), F.transform(F.regexp_extract_all(c, F.lit(before_post), F.lit(1)), trimmed))
    first = lambda names: F.get(F.filter(names, looks_like_person), F.lit(0))
    return F.coalesce(first(of_label), first(of_post))


def extract_contacts(c: Column) -> Column:
    """struct(phones, emails, phone, email, name, complete)."""
    phones, emails, name = find_phones(c), find_emails(c), find_contact_name(c)
    first = lambda a: F.get(a, F.lit(0))
    complete = (F.size(phones) > 0) & (F.size(emails) > 0) & name.isNotNull()
    return F.struct(phones.alias("phones"), emails.alias("emails"), first(phones).alias("phone"), first(emails).alias("email"), name.alias("name"), complete.alias("complete"))


def contact_links(links: Column, page: Column) -> Column:
    """Distinct absolute addresses of the links whose address or text speaks of contact, in order."""
    from . import markup

    like = F.filter(links, lambda a: F.lower(F.concat_ws(" ", a["href"], a["text"])).rlike(r"contact|reach[\s_-]*us|get[\s_-]*in[\s_-]*touch|enquir"))
    return F.array_distinct(F.filter(F.transform(like, lambda a: markup.clean_url(a["href"], page)), lambda u: u.isNotNull()))
