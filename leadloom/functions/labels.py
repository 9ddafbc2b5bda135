"""Lines and labels that people read: terms, openers, alerts, deliveries, orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup, strings

#: The host that wraps links to articles.
NEWS_HOST = "news.google.com"


def is_wrapped_news_link(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))) == NEWS_HOST, F.lit(False))


def requirement_terms(quantity: Column, deadline: Column, unreadable: Column) -> Column:
    """What is asked and until when, or why that is not known."""
    terms = strings.blank_to_null(strings.join_nonblank(" - ", strings.clip(quantity, 34), F.concat(F.lit("closes "), deadline.cast("string"))))
    return F.coalesce(terms, F.when(unreadable, "document could not be read as text"), F.lit("no quantity or closing date stated"))


def requirement_contact(name: Column, phone: Column, email: Column) -> Column:
    return F.coalesce(strings.blank_to_null(strings.join_nonblank(", ", name, phone, email)), F.lit("contact not found yet"))


def opener(kind: Column, segment: Column, what: Column, templates: dict[str, str]) -> Column:
    """The line to open a talk with: templates 'requirement' and 'registration' take {what}, others go by segment, else 'other'."""
    short = F.regexp_replace(strings.tidy(what, 50), r"\.$", "")
    filled = lambda name, text: F.replace(F.lit(templates[name]), F.lit("{what}"), text)
    known = F.when((what.isNotNull()) & (short != ""), short)
    by_segment = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    return (
        F.when(kind == "requirement", filled("requirement", F.coalesce(strings.lower_first(known), F.lit("the requirement"))))
        .when((kind == "registration") & known.isNotNull(), filled("registration", known))
        .when(kind == "registration", F.lit(templates["registration_plain"]))
        .otherwise(F.coalesce(F.try_element_at(by_segment, segment), F.lit(templates["other"])))
    )


def alert_label(a: Column) -> Column:
    """What became of an alert: struct(skipped, whatsapp<sent, window_closed, failed_later, reason>, email<sent, reason>)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    w, e = a["whatsapp"], a["email"]
    by_mail = (
        F.when(yes(w["window_closed"]), F.when(yes(w["failed_later"]), "email (WhatsApp failed: window closed)").otherwise("email (WhatsApp window closed)"))
        .when(yes(w["failed_later"]), "email (WhatsApp failed after sending)")
        .otherwise("email (WhatsApp refused)")
    )
    failed = lambda c: F.concat(F.lit("not delivered: "), strings.blank_to_null(c))
    return F.when(yes(a["skipped"]), "not sent").when(yes(w["sent"]), "WhatsApp sent").when(yes(e["sent"]), by_mail).otherwise(F.coalesce(failed(w["reason"]), failed(e["reason"]), F.lit("no alert recorded")))


def alert_missed(a: Column) -> Column:
    """Whether no channel took the alert."""
    sent = lambda c: F.coalesce(c["sent"], F.lit(False))
    return ~(sent(a["whatsapp"]) | sent(a["email"]))


def delivery_label(row: Column) -> Column:
    """A day's delivery in one line: struct(email<sent, reason>, whatsapp<sent, resent, via, reason>, failed_later, resent_id, code)."""
    e, w = row["email"], row["whatsapp"]
    mailed, sent, later = (F.coalesce(c, F.lit(False)) for c in (e["sent"], w["sent"], row["failed_later"]))
    failed = F.concat(F.lit("WhatsApp failed: "), F.coalesce(row["code"].cast("string"), F.lit("no code")))
    put = lambda text: F.concat(F.lit(text + " ("), failed, F.lit(")"))
    not_delivered = lambda c: F.concat(F.lit("not delivered: "), strings.blank_to_null(c))
    resent = row["resent_id"].isNotNull()
    reason = strings.blank_to_null(w["reason"])
    return (
        F.when(later & ~sent & resent, F.when(mailed, put("email, then the template resent")).otherwise(put("template resent")))
        .when(later & ~sent, F.when(mailed, put("email only")).otherwise(put("not delivered")))
        .when(sent & mailed, F.when(F.coalesce(w["resent"], F.lit(False)), "email, then the template resent").otherwise("email and WhatsApp"))
        .when(sent, F.when(w["via"] == "template", "WhatsApp (template)").otherwise("WhatsApp"))
        .when(mailed, F.coalesce(F.concat(F.lit("email only ("), reason, F.lit(")")), F.lit("email only")))
        .otherwise(F.coalesce(not_delivered(e["reason"]), not_delivered(w["reason"]), F.lit("nothing recorded")))
    )


def order_lines(products: Column, details: Column) -> Column:
    """The products in one line, then each line of the details."""
    named = F.array_join(F.coalesce(products, F.array().cast("array<string>")), ", ")
    lines = F.transform(F.split(F.coalesce(details, F.lit("")), r"\r?\n"), lambda x: strings.tidy(x, 200))
    return F.filter(F.concat(F.array(named), lines), lambda x: x != "")


def why_now_from_order(day: Column, lines: Column) -> Column:
    return strings.tidy(F.concat(F.lit("Ordered on "), day.cast("string"), F.lit(": "), F.array_join(F.slice(lines, 1, 3), "; ")), 120)


def catalogue_label(item: Column, labels: dict[str, str]) -> Column:
    """The catalogue's label of an item, else its id in words."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, item), F.initcap(F.regexp_replace(item, "[_-]+", " ")))


def concrete_facts(evidence: Column, page_title: Column, requirement: Column, quantity: Column, deadline: Column) -> Column:
    """The facts that an opener can be built on, in the order of their use."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    facts = [
        (F.coalesce(F.size(evidence) > 0, F.lit(False)), "an evidence quote from their own page"), (some(page_title), "the title of their website"),
        (some(requirement), "the requirement text on the notice"), (some(quantity), "a stated quantity"), (deadline.isNotNull(), "a stated deadline"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in facts)), lambda t: t.isNotNull())


def city_named(text: Column, cities: dict[str, tuple[str, ...]]) -> Column:
    """The city of the first name or alias in a text, or null."""
    from ..operators.matching import phrase_pattern

    alias = {a.lower(): city for city, aliases in cities.items() for a in (city, *aliases)}
    found = F.lower(F.regexp_replace(F.regexp_extract(text, phrase_pattern(list(alias)), 1), r"\s+", " "))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), found)


def site_from_article(links: Column, host: Column, organisation: Column, said: Column, refused: tuple[str, ...]) -> Column:
    """The site that the answer names, unless its host is refused; else the first link elsewhere whose text has a longer word of the organisation."""
    of = lambda url: F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    allowed = lambda url: F.coalesce(~of(url).isin(*refused), F.lit(False)) & of(url).contains(".")
    site = strings.website(said)
    words = F.filter(F.split(F.lower(F.coalesce(organisation, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    fits = lambda a: F.exists(words, lambda w: F.lower(a["text"]).contains(w)) & allowed(a["href"]) & (of(a["href"]) != F.regexp_replace(F.lower(host), "^www\\.", ""))
    return F.coalesce(F.when(allowed(site), site), F.get(F.filter(links, fits), F.lit(0))["href"])


def unlinked_matches(html: Column, matches) -> Column:
    """The cells of matching table rows that hold no anchor, joined."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr>)"), F.lit(1))
    bare = F.filter(rows, lambda r: ~r.rlike(r"(?i)<a\b"))
    texts = F.transform(bare, lambda r: F.array_join(F.flatten(markup.table_rows(r)), " "))
    return F.filter(texts, matches)
