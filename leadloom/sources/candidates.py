"""Readers that turn source documents into candidate rows: one DataFrame of raw bodies in, one of candidates out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import contacts, dates, hashing, markup, quantity, strings
from ..operators import dedupe, matching
from ..operators.ranking import top_per


def segment_of_tags(tags: Column) -> Column:
    """The first rule of map tags that holds."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    return (
        F.when(tag("industrial") == "food", "food_manufacturer")
        .when(tag("shop") == "wholesale", "wholesale")
        .when(tag("tourism") == "hotel", "hotel")
        .when(tag("craft") == "caterer", "caterer")
        .when(tag("amenity").isin("restaurant", "food_court"), "restaurant")
        .when(tag("shop").isin("greengrocer", "supermarket"), "retailer")
        .when((tag("shop") == "trade") | (tag("office") == "wholesale"), "distributor")
        .otherwise("other")
    )


#: The tags of a map element that a candidate keeps.
KEPT_TAGS = ("amenity", "shop", "tourism", "craft", "industrial", "cuisine", "opening_hours", "operator", "brand", "addr:city", "addr:street", "addr:postcode")
_POINT = "lat:double,lon:double"
MAP_BODY = f"struct<elements:array<struct<type:string,id:bigint,{_POINT},center:struct<{_POINT}>,tags:map<string,string>>>>"


def excluded(c: Column, profile: Profile) -> Column:
    return c.rlike("(?iu)" + "|".join(profile.exclude)) if profile.exclude else F.lit(False)


def map_listings(bodies: DataFrame, profile: Profile, body: str = "body") -> DataFrame:
    """Buyers of a map extract: named elements, without excluded ones, with coordinates of the element or its centre."""
    e = bodies.select(F.explode(F.from_json(body, MAP_BODY)["elements"]).alias("e"))
    tag = lambda k: F.when(F.try_element_at("e.tags", F.lit(k)) != "", F.try_element_at("e.tags", F.lit(k)))
    name = F.coalesce(tag("name"), tag("name:en"), tag("operator"), tag("brand"))
    rows = e.withColumn("name", strings.tidy(name, 160)).where(name.isNotNull()).where(~excluded(F.col("name"), profile))
    return rows.select(
        F.lit("map").alias("source"), F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("external_id"), F.lit("buyer").alias("kind"), segment_of_tags(F.col("e.tags")).alias("segment"), "name",
        F.coalesce(tag("addr:city"), F.lit(profile.city)).alias("city"), strings.map_address(F.col("e.tags")).alias("address"), strings.phone(F.coalesce(tag("phone"), tag("contact:phone"))).alias("phone"),
        strings.email(F.coalesce(tag("email"), tag("contact:email"))).alias("email"), strings.website(F.coalesce(tag("website"), tag("contact:website"))).alias("website"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.map_filter("e.tags", lambda k, v: k.isin(*KEPT_TAGS) & (v != "")).alias("tags"),
    )


def inside(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def _feed_date(c: Column) -> Column:
    """RFC 822 or ISO."""
    return F.coalesce(dates.parse_date(F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def news_items(feeds: DataFrame, profile: Profile, body: str = "body") -> DataFrame:
    """Signals of an aggregator's feed: items with title and link, headline and publication parted."""
    i = feeds.select(F.explode(markup.feed_items(F.col(body))).alias("i")).where("i.title <> '' AND i.link <> ''")
    headline, publication = strings.split_title(F.col("i.title"))
    rows = i.where(~excluded(F.col("i.title"), profile))
    id_ = F.when(F.col("i.guid") != "", F.col("i.guid")).otherwise(hashing.short_hash(24, F.col("i.link")))
    return rows.select(F.lit("news").alias("source"), id_.alias("external_id"), F.lit("signal").alias("kind"), strings.tidy(headline, 200).alias("name"), publication.alias("publication"), F.col("i.link").alias("source_url"), _feed_date(F.col("i.published")).alias("why_now_date"))


def publisher_items(feeds: DataFrame, profile: Profile, today: Column, max_age: int = 45, per_feed: int = 8, body: str = "body") -> DataFrame:
    """Items of publishers' feeds (feed, url, body) with what became of each: kept, over the cap, repeated, stale, unusable link, unmatched.

    A rule must match, the link be usable, the age at most `max_age` days; the first of each address counts, up to
    `per_feed` of a feed, in the order of the document.
    """
    rows = feeds.select("feed", "url", F.posexplode(markup.feed_items(F.col(body))).alias("pos", "i"))
    text = F.concat_ws(" ", strings.tidy(markup.strip_tags(F.col("i.title")), 200), strings.tidy(markup.strip_tags(F.col("i.description")), 600))
    rows = rows.withColumn("title", strings.tidy(markup.strip_tags(F.col("i.title")), 200)).where("title <> ''")
    rows = rows.withColumn("rule", matching.item_rule(text, profile)).withColumn("link", markup.clean_url(F.col("i.link"), F.col("url"))).withColumn("date", _feed_date(F.col("i.published")))
    stale = F.coalesce(dates.days_between(F.col("date"), today) > max_age, F.lit(False))
    rows = rows.withColumn("outcome", F.when(F.col("rule").isNull(), "unmatched").when(F.col("link").isNull(), "unusable link").when(stale, "stale"))
    good = top_per(rows.where("outcome IS NULL"), ["feed", "link"], ["pos"], 1_000_000_000, "nth")
    fresh = top_per(good.where("nth = 1"), ["feed"], ["pos"], 1_000_000_000, "place").withColumn("outcome", F.when(F.col("place") <= per_feed, "kept").otherwise("over the cap"))
    columns = ["feed", "pos", "title", "link", "rule", "date", "outcome"]
    return fresh.select(columns).unionByName(good.where("nth > 1").withColumn("outcome", F.lit("repeated")).select(columns)).unionByName(rows.where("outcome IS NOT NULL").select(columns))


def feed_stats(items: DataFrame) -> DataFrame:
    """Counters of each feed."""
    one = lambda c: F.count(F.when(c, 1))
    outcome = lambda o: one(F.col("outcome") == o)
    kept = F.col("outcome") == "kept"
    return items.groupBy("feed").agg(
        F.count("*").alias("items"), one(kept).alias("kept"), one(kept & (F.col("rule") == "demand")).alias("demand"), one(kept & (F.col("rule") == "opening")).alias("opening"),
        outcome("unmatched").alias("unmatched"), outcome("stale").alias("stale"), outcome("unusable link").alias("unusable_link"),
    )


PRICE_BODY = "struct<records:array<struct<state:string,district:string,market:string,commodity:string,variety:string,arrival_date:string,min_price:string,max_price:string,modal_price:string>>>"


def mandi_prices(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Price rows: numbers or null, day-first dates, an id of everything that tells readings apart."""
    r = bodies.select(F.explode(F.from_json(body, PRICE_BODY)["records"]).alias("r"))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double")
    parts = ("state", "district", "market", "commodity", "variety", "arrival_date")
    return r.select(
        F.concat_ws("|", *(F.when(F.col(f"r.{p}") != "", F.col(f"r.{p}")) for p in parts)).alias("external_id"), "r.commodity", "r.variety", "r.market", "r.district", "r.state",
        dates.parse_date(F.col("r.arrival_date")).alias("date"), number("r.min_price").alias("min_price"), number("r.max_price").alias("max_price"), number("r.modal_price").alias("modal_price"),
    )


def price_requests(states: DataFrame, commodities: DataFrame) -> DataFrame:
    """One request for each state and commodity of a profile: two short lists of dimension values."""
    return states.select("state", F.lit(1).alias("one")).join(F.broadcast(commodities.select("commodity", F.lit(1).alias("one"))), "one").drop("one")


def tenders(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tender rows of five cells and more that carry an id; the second date closes, the last cell is the buyer."""
    r = pages.select(F.explode(markup.table_rows(F.col(html))).alias("c")).where("size(c) >= 5").withColumn("all", F.array_join("c", " "))
    header = F.col("c")[0].rlike(r"(?i)tender\s*id|s\.?\s*no")
    rows = r.where(~header).withColumn("external_id", F.regexp_extract("all", r"\b(\d{4}_[A-Z0-9_]+_\d+_\d+)\b", 1)).where("external_id <> ''")
    closing = dates.parse_date(F.get(F.regexp_extract_all("all", F.lit(r"(\d{2}-[A-Za-z]{3}-\d{4})"), F.lit(1)), F.lit(1)))
    title = F.get(F.filter("c", lambda x: (F.length(x) > 20) & ~x.contains(F.col("external_id"))), F.lit(0))
    return rows.select("external_id", F.lit("tender").alias("kind"), strings.tidy(F.coalesce(title, F.col("external_id")), 160).alias("name"), F.element_at("c", -1).alias("organisation"), closing.alias("deadline"))


def notice_links(pages: DataFrame, words: list[str], profile: Profile, html: str = "html", url: str = "url") -> DataFrame:
    """Links to notices (url of the page, link, title, keyword, via): anchors that match, and links in table rows that match.

    The longest title of an address wins, the first of equal ones.
    """
    skip = r"(?i)^(?:mailto:|tel:|javascript:|#)"
    anchors = pages.select(F.col(url).alias("page"), F.posexplode(markup.links(F.col(html))).alias("pos", "a"))
    anchors = anchors.select("page", "pos", F.col("a.href").alias("href"), F.when(F.col("a.text") != "", F.col("a.text")).otherwise(F.col("a.href")).alias("title"), F.concat_ws(" ", "a.text", "a.href").alias("text"), F.lit("anchor").alias("via"))
    trs = pages.select(F.col(url).alias("page"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr"))
    in_rows = trs.select("page", (F.col("pos") + 1_000_000).alias("pos"), F.explode(markup.links(F.col("tr"))).alias("a"), markup.strip_tags(F.col("tr")).alias("text"))
    in_rows = in_rows.select("page", "pos", F.col("a.href").alias("href"), F.col("text").alias("title"), "text", F.lit("table row").alias("via"))
    both = anchors.unionByName(in_rows).where(~F.col("href").rlike(skip)).withColumn("keyword", matching.matched_keyword(F.col("text"), words)).where("keyword IS NOT NULL")
    both = both.withColumn("link", markup.clean_url(F.col("href"), F.col("page"))).withColumn("title", strings.tidy(F.col("title"), 200))
    both = both.where(F.col("link").isNotNull() & (F.col("title") != "") & ~excluded(F.col("title"), profile) & (F.col("link") != F.regexp_replace("page", "#.*$", "")))
    return dedupe.keep_first(both, ["page", "link"], [F.desc(F.length("title")), "pos"]).select("page", "link", "title", "keyword", "via")


def notices(documents: DataFrame, profile: Profile, today: Column, text: str = "text") -> DataFrame:
    """Requirements of notice documents (link, title, text): quantity, fit, closing date, contacts."""
    t = F.col(text)
    q = quantity.best_quantity(t)
    least, most = profile.kg_per_day
    fit = quantity.quantity_fit(q["kg"], q["kg_per_day"], matching.mentions(t, list(profile.produce_words[:1])), least, most, profile.headline_kg_per_day)
    rows = documents.withColumn("q", q).withColumn("deadline", dates.find_deadline(t, today)).withColumn("c", contacts.extract_contacts(t))
    return rows.select(
        hashing.notice_id("inst_", F.col("link"), length=20).alias("external_id"), F.lit("requirement").alias("kind"), strings.tidy(F.col("title"), 200).alias("requirement"), F.col("q.phrase").alias("quantity"), F.col("q.kg").alias("quantity_kg"), fit.alias("quantity_fit"), "deadline",
        F.col("c.name").alias("contact_name"), F.col("c.phone").alias("phone"), F.col("c.email").alias("email"), F.col("link").alias("document_url"),
    )


_NAMES = "b_bid_number:string,b_category_name:string,b_total_quantity:string,b_bid_end_date_sort:string,b_unit:string,ba_official_details_deptName:string,ba_official_details_officeZone:string"
BID_BODY = f"struct<response:struct<response:struct<docs:array<struct<{_NAMES}>>>>>"


def bids(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bids of a JSON listing; a body of another shape gives one row with ok = false and the reason."""
    docs = F.from_json(body, BID_BODY)["response"]["response"]["docs"]
    rows = bodies.select(F.explode_outer(docs).alias("b"), docs.isNotNull().alias("ok"))
    good = F.col("ok") & (F.col("b.b_bid_number") != "") & (F.col("b.b_category_name") != "")
    amount = F.col("b.b_total_quantity").try_cast("double")
    out = rows.where(good | ~F.col("ok")).select(
        "ok", F.when(~F.col("ok"), "unrecognised shape").alias("reason"), F.concat(F.lit("gem_"), hashing.short_hash(20, F.col("b.b_bid_number"))).alias("external_id"), strings.tidy(F.col("b.b_category_name"), 200).alias("requirement"),
        strings.tidy(F.coalesce("b.ba_official_details_deptName", "b.ba_official_details_officeZone"), 160).alias("name"), F.when(amount > 0, F.concat_ws(" ", amount.cast("bigint").cast("string"), F.coalesce("b.b_unit", F.lit("units")))).alias("quantity"),
        F.try_to_date(F.substring("b.b_bid_end_date_sort", 1, 10), "yyyy-MM-dd").alias("deadline"),
    )
    return out.withColumn("external_id", F.when(F.col("ok"), F.col("external_id")))


def exporter_cards(pages: DataFrame, profile: Profile, card: str = r'(?is)<div class="card[^"]*">(.*?)</div>', html: str = "html") -> DataFrame:
    """Cards whose paragraphs are name, address, product, state and postcode; the first of each name and state."""
    cards = pages.select(F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), F.lit(1))).alias("pos", "card"))
    parts = F.filter(F.transform(F.regexp_extract_all("card", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), markup.strip_tags), lambda x: x != "")
    rows = cards.withColumn("p", parts).where("size(p) >= 2")
    at = lambda i: F.get(F.col("p"), F.lit(i))
    rows = rows.select("pos", strings.tidy(at(0), 160).alias("name"), strings.tidy(at(1), 240).alias("address"), at(2).alias("product"), at(3).alias("state"), F.when(at(4).rlike(r"^\d{6}$"), at(4)).alias("pin"))
    return dedupe.keep_first(rows.where(~excluded(F.col("name"), profile)), ["name", "state"], ["pos"]).drop("pos")


ORDER_FIELDS = "orderId:string,order_id:string,createdAt:string,created_at:string,status:string,contactName:string,contact_name:string,businessName:string,business_name:string,phone:string,email:string,city:string,businessType:string,business_type:string,products:array<string>,orderDetails:string,order_details:string,schedule:string,neededBy:string,needed_by:string,notes:string"
ORDER_BODY = f"struct<eventId:string,event_id:string,order:struct<{ORDER_FIELDS}>,{ORDER_FIELDS}>"


def orders(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Orders in an envelope or bare, in either spelling; ok is false with the missing fields named."""
    o = bodies.select(F.from_json(body, ORDER_BODY).alias("e"))
    field = lambda *names: F.coalesce(*(F.col(f"e.order.{n}") for n in names), *(F.col(f"e.{n}") for n in names))
    products = F.slice(F.filter(F.transform(field("products"), lambda p: strings.tidy(p, 100)), lambda p: p != ""), 1, 50)
    details = strings.multiline(field("orderDetails", "order_details"), 1500)
    rows = o.select(
        F.substring(field("orderId", "order_id"), 1, 64).alias("id"), field("createdAt", "created_at").try_cast("timestamp").alias("created_at"), F.coalesce(field("status"), F.lit("new-awaiting-confirmation")).alias("status"),
        strings.tidy(field("contactName", "contact_name"), 80).alias("contact_name"), strings.tidy(field("businessName", "business_name"), 120).alias("business_name"), strings.phone(field("phone")).alias("phone"), strings.email(field("email")).alias("email"),
        field("city").alias("city"), field("businessType", "business_type").alias("business_type"), F.coalesce(products, F.array().cast("array<string>")).alias("products"), strings.blank_to_null(details).alias("order_details"), F.try_to_date(field("neededBy", "needed_by"), "yyyy-MM-dd").alias("needed_by"),
        strings.blank_to_null(strings.multiline(field("notes"), 1000)).alias("notes"),
    )
    missing = F.concat_ws(", ", F.when(F.coalesce("id", F.lit("")) == "", "orderId"), F.when(F.col("order_details").isNull() & (F.size("products") == 0), "orderDetails or products"))
    return rows.withColumn("missing", missing).withColumn("ok", F.col("missing") == "")


def reachable(entries: DataFrame, probe: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Entries to fetch, and those a probe found unreachable with its reason."""
    dead = probe.where("NOT reachable").select(key, "reason")
    return entries.join(dead, key, "left_anti"), entries.join(dead, key)


def weekly_due(c: Column) -> Column:
    """Weekly sources run on Mondays."""
    return F.dayofweek(c) == 2


def to_lead(candidates: DataFrame, now: Column) -> DataFrame:
    """Register rows of candidates: ids from source and external id, contacts in one form, texts within their limits, the rest at their defaults."""
    null = F.lit(None).cast("string")
    segment = F.coalesce("segment", F.lit("other"))
    return candidates.select(
        hashing.lead_id(F.col("source"), F.col("external_id")).alias("id"), F.coalesce("kind", F.lit("buyer")).alias("kind"), segment.alias("segment"), segment.alias("segment_source"), null.alias("segment_model"),
        null.alias("opener_model"), strings.tidy(F.col("name"), 160).alias("name"), "city", "state", strings.tidy(F.col("address"), 240).alias("address"), strings.phone(F.col("phone")).alias("phone"),
        strings.email(F.col("email")).alias("email"), strings.website(F.col("website")).alias("website"), strings.tidy(F.col("why_now"), 120).alias("why_now"), "why_now_date", "source", "source_url", "licence",
        now.alias("first_seen"), now.alias("last_seen"), F.lit(0).alias("score"), F.lit("new").alias("status"), null.alias("notes"), F.col("phone").alias("raw_phone"),
    )


def registrations(entries: DataFrame, checks: DataFrame, segments: dict[str, str]) -> DataFrame:
    """Candidates of a registry (name, url, type, city, buys, how, contact) and the checks of its pages (url, ok, status, text, reason).

    Contacts come from a page that answered, else from an address that the registry itself states; segments maps types, others are distributors.
    """
    met = entries.join(checks.select("url", "ok", F.col("status").alias("page_status"), "text", "reason"), "url", "left").withColumn("live", F.coalesce("ok", F.lit(False)))
    met = met.withColumn("c", F.when(F.col("live"), contacts.extract_contacts(F.coalesce("text", F.lit("")))))
    stated = F.when(F.col("contact").contains("@"), F.col("contact"))
    of_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in segments.items() for x in kv]), F.col("type")) if segments else F.lit(None).cast("string")
    return met.select(
        F.lit("registrations").alias("source"), F.concat(F.lit("reg_"), hashing.short_hash(20, F.col("url"))).alias("external_id"), F.lit("registration").alias("kind"),
        F.coalesce(of_type, F.lit("distributor")).alias("segment"), "name", "city", F.col("c.phone").alias("phone"), F.coalesce(F.col("c.email"), stated).alias("email"), F.col("url").alias("website"),
        F.when(F.col("live"), "supplier registration page is live").otherwise("supplier registration page did not answer").alias("why_now"), strings.tidy(F.col("buys"), 200).alias("requirement"),
        strings.tidy(F.col("how"), 200).alias("how"), F.col("c.name").alias("contact_name"), "live", "page_status", F.when(~F.col("live"), F.col("reason")).alias("check_reason"),
        F.coalesce(F.col("c.phone"), F.col("c.email"), stated).isNotNull().alias("contact_complete"), F.coalesce(F.col("c.phone"), F.col("c.email")).isNotNull().alias("contact_from_page"),
    )


def registry(bodies: DataFrame, fields: dict[str, str], required: tuple[str, ...] = ("name", "url"), body: str = "body") -> DataFrame:
    """Entries of registry files, which are a JSON list or an object with 'entries'; those without a required field are left out."""
    entry = "array<struct<" + ",".join(f"{k}:{t}" for k, t in fields.items()) + ">>"
    listed = F.when(F.ltrim(F.col(body)).startswith("["), F.from_json(body, entry)).otherwise(F.from_json(body, f"struct<entries:{entry}>")["entries"])
    rows = bodies.select(F.explode(listed).alias("e")).select("e.*")
    return rows.where(" AND ".join(f"coalesce(CAST(`{f}` AS STRING), '') <> ''" for f in required))


def latest_digest(files: DataFrame, path: str = "path") -> DataFrame:
    """(day, kind): the last day that has a digest file <day>.txt, and the files of that day beside it; none where there is none."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    parts = files.select(F.try_to_date(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})\.", 1), "yyyy-MM-dd").alias("day"), F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}\.(.+)$", 1).alias("kind"), path).where("day IS NOT NULL")
    last = parts.where("kind = 'txt'").agg(F.max("day").alias("day"))
    return parts.join(F.broadcast(last), "day")  # last is one row
