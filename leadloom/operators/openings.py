"""Signals that become requirements: their tier, what ends the reading of each, what is written on them, and when a model is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import contacts, dates, labels, markup, quantity, strings
from . import matching
from .scans import running_sums

CANDIDATE, AWARENESS = "requirement_candidate", "awareness"


def tier_of(stated: Column, text: Column, profile: Profile) -> Column:
    """The tier a signal states, else the one its text gives it."""
    read = F.when(matching.item_rule(text, profile).eqNullSafe("demand"), CANDIDATE).otherwise(AWARENESS)
    return F.coalesce(F.when(stated.isin(CANDIDATE, AWARENESS), stated), read)


def plain_reads(text: Column, today: Column) -> Column:
    """What a text says by itself: struct(quantity, deadline, contacts)."""
    return F.struct(quantity.best_quantity(text)["phrase"].alias("quantity"), dates.find_deadline(text, today).alias("deadline"), contacts.extract_contacts(text).alias("contacts"))


def opener_reason(in_digest: Column, facts: Column) -> Column:
    """struct(needed, reason) of a call for an opener."""
    few = F.size(facts) == 0
    reason = F.when(~in_digest, "not in the digest").when(few, "no fact to build on").otherwise(F.concat(F.lit("has "), F.array_join(facts, ", ")))
    return F.struct((in_digest & ~few).alias("needed"), reason.alias("reason"))


def requirement_reason(text: Column, of_publisher: Column, reads: Column, profile: Profile) -> Column:
    """struct(needed, reason) of a call for a requirement: never without text or procurement wording; always for a publisher's article; else if nothing was read."""
    some = F.coalesce(text, F.lit("")) != ""
    worded = F.coalesce(matching.mentions(text, list(profile.requirement_words)), F.lit(False))
    c = reads["contacts"]
    found = F.concat_ws(", ", F.when(reads["quantity"].isNotNull(), "a quantity"), F.when(reads["deadline"].isNotNull(), "a closing date"), F.when(F.coalesce(c["phone"], c["email"]).isNotNull(), "a contact"))
    needed = some & worded & (of_publisher | (found == ""))
    reason = (
        F.when(~some, "no text").when(~worded, "no procurement wording").when(of_publisher, "an article does not name the buyer's site")
        .when(found != "", F.concat(F.lit("already read: "), found)).otherwise("nothing read")
    )
    return F.struct(needed.alias("needed"), reason.alias("reason"))


def outcomes(
    signals: DataFrame, links: DataFrame, articles: DataFrame, answers: DataFrame, site_contacts: DataFrame, profile: Profile, read_cap: int = 6, gate: float = 0.7, refused: tuple[str, ...] = ()
) -> DataFrame:
    """Adds outcome and why to signals (id, place, tier), beside what was read of each.

    links (id, url, link_reason), articles (url, article_ok, host, html, text, article_reason), answers (id, answer_ok, is_requirement,
    confidence, organisation, said_site, requirement, quantity, deadline, answer_reason) and site_contacts (site, contact_ok, phone, email,
    name, contact_reason) hold one row of each key; what is missing there was not fetched. Only candidates are joined. Articles are
    counted against the cap by running sums over the candidates' places, however many there are; places must tell candidates apart.
    """
    waiting = signals.where(F.col("tier") == CANDIDATE)
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    read = waiting.join(links, "id", "left").join(articles, "url", "left")
    own = yes("article_ok").cast("long")
    counted = running_sums(read, [F.asc("place"), F.asc("id")], {"reads_before": own})
    met = counted.withColumn("reads_before", F.col("reads_before") - own).join(answers, "id", "left")
    site = labels.site_from_article(markup.links(F.col("html")), F.col("host"), F.col("organisation"), F.col("said_site"), refused)
    met = met.withColumn("site", site).join(site_contacts, "site", "left")
    worded = F.coalesce(matching.mentions(F.col("text"), list(profile.requirement_words)), F.lit(False))
    exits = [
        (F.col("reads_before") >= read_cap, "capped", F.lit(f"the {read_cap} articles of this run were read before")),
        (F.col("url").isNull(), "link_unresolved", F.coalesce("link_reason", F.lit("no link"))),
        (~yes("article_ok"), "article_skipped", F.coalesce("article_reason", F.lit("not fetched"))),
        (~worded, "not_needed", F.lit("no procurement wording")),
        (~yes("answer_ok"), "no_answer", F.coalesce("answer_reason", F.lit("not asked"))),
        (~yes("is_requirement"), "no_requirement", F.lit("the article asks for nothing")),
        (F.coalesce("confidence", F.lit(0.0)) < gate, "below_gate", F.concat(F.lit("confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("unknown")))),
        (F.col("site").isNull(), "no_site", F.lit("no site of the organisation")),
        (~yes("contact_ok"), "no_contact", F.coalesce("contact_reason", F.lit("site not read"))),
    ]
    first = F.coalesce(*(F.when(c, F.struct(F.lit(o).alias("outcome"), w.alias("why"))) for c, o, w in exits), F.struct(F.lit("upgraded").alias("outcome"), F.lit(None).cast("string").alias("why")))
    told = met.withColumn("__exit", first).select("*", "__exit.outcome", "__exit.why").drop("__exit", "reads_before")
    rest = signals.where(~F.col("tier").eqNullSafe(CANDIDATE)).withColumn("outcome", F.lit(AWARENESS)).withColumn("why", F.lit("an opening or expansion, not a requirement"))
    return told.unionByName(rest, allowMissingColumns=True)


def applied(leads: DataFrame, read: DataFrame) -> DataFrame:
    """Leads (id, kind, name, phone, email, website, why_now) with the outcome of their signals written on them; others as they were.

    An upgraded one becomes a requirement with the contact of the site; one that was read in vain keeps the reason and what the answer
    said; an unread article changes nothing; awareness says what it is where there was no reason.
    """
    o = read.select("id", "outcome", "why", "site", F.col("phone").alias("__phone"), F.col("email").alias("__email"), "requirement", "quantity", "deadline")
    met = leads.join(o, "id", "left")
    up, aware = F.col("outcome").eqNullSafe("upgraded"), F.col("outcome").eqNullSafe(AWARENESS)
    unread = F.coalesce(F.col("outcome").isin("article_skipped", "no_answer", AWARENESS), F.lit(True))
    reported = F.coalesce(F.concat(F.lit("requirement reported, closes "), F.col("deadline").cast("string")), F.concat(F.lit("requirement reported: "), F.coalesce("requirement", "why_now", F.lit("opening or expansion"))))
    why_now = F.when(up, strings.tidy(reported, 120)).when(aware, F.coalesce("why_now", F.lit("opening or expansion reported"))).otherwise(F.col("why_now"))
    kept = lambda name: F.when(~unread, F.col(name)).alias(name)
    return met.select(
        "id", F.when(up, "requirement").otherwise(F.col("kind")).alias("kind"), "name", F.when(up, F.coalesce("phone", "__phone")).otherwise(F.col("phone")).alias("phone"),
        F.when(up, F.coalesce("email", "__email")).otherwise(F.col("email")).alias("email"), F.when(up, F.coalesce("website", "site")).otherwise(F.col("website")).alias("website"), why_now.alias("why_now"),
        F.when(up, strings.tidy(F.coalesce("requirement", "name"), 200)).otherwise(kept("requirement")).alias("requirement"), kept("quantity"), kept("deadline"),
        F.when(~unread, up).alias("contact_complete"), F.when(~unread & ~up, strings.tidy(F.col("why"), 200)).alias("contact_not_found"), aware.alias("awareness_only"),
    )


def enriched(leads: DataFrame, answers: DataFrame, version: str) -> DataFrame:
    """Leads with the answer of a model beside them: segment_source keeps what the source said, segment_model and llm the second opinion."""
    llm = F.struct(*(F.col(f"__a.{c}").alias(c) for c in ("segment", "size", "buys", "deadline", "confidence")), F.lit(version).alias("version"))
    met = leads.join(answers.select("id", F.struct(*(c for c in answers.columns if c != "id")).alias("__a")), "id", "left")
    there = F.col("__a").isNotNull()
    return met.withColumn("segment_source", F.coalesce("segment_source", F.when(there, F.col("segment")))).withColumn("segment_model", F.when(there, F.col("__a.segment")).otherwise(F.col("segment_model"))).withColumn(
        "llm", F.when(there, llm)
    ).drop("__a")


def to_enrich(leads: DataFrame, limit: int, version: str) -> DataFrame:
    """The leads to read next: not prices, with an address, not read at this version; by score, own website first."""
    url = F.coalesce("website", "source_url")
    rows = leads.where((F.col("kind") != "price") & url.isNotNull() & ~F.col("llm_version").eqNullSafe(version))
    return rows.orderBy(F.desc("score"), F.col("website").isNull(), "id").limit(limit)


def openers_to_write(index: DataFrame, leads: DataFrame, limit: int, version: str) -> DataFrame:
    """The first `limit` labels of a digest (label, place, id) whose lead lacks an opener of this version, with whether facts call for one."""
    shown = index.orderBy("place", "label").limit(limit).join(leads, "id")
    stale = ~(F.col("opener_version").eqNullSafe(version) & F.col("opener_model").isNotNull())
    return shown.where(stale).withColumn("gate", opener_reason(F.lit(True), F.col("facts")))
