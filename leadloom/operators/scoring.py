"""Rule scores of leads and requirements as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dates, strings


def points(table: dict[str, int], key: Column, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def has(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def contact_band(phone: Column, email: Column, website: Column) -> Column:
    return F.when(has(phone), "phone").when(has(email), "email").when(has(website), "website").otherwise("none")


def recency_band(date: Column, today: Column) -> Column:
    age = dates.days_between(date, today)
    return F.when(age.isNull(), "unknown").when(age <= 14, "within14").when(age <= 30, "within30").otherwise("older")


def deadline_band(date: Column, today: Column) -> Column:
    left = dates.days_between(today, date)
    return F.when(left.isNull(), "none").when(left < 0, "closed").when(left <= 7, "within7").when(left <= 14, "within14").when(left <= 30, "within30").otherwise("later")


def requirement_contact_band(phone: Column, email: Column, name: Column) -> Column:
    return F.when(has(phone) & has(email), "phone_and_email").when(has(phone), "phone").when(has(email), "email").when(has(name), "name_only").otherwise("none")


def place_band(city: Column, state: Column, profile: C.Profile) -> Column:
    key = lambda c: strings.city_key(c)
    in_state = (key(state) == key(F.lit(profile.state))) & has(state) if profile.state else F.lit(False)
    return F.when(key(city) == key(F.lit(profile.city)), "city").when(in_state, "state").otherwise("elsewhere")


def penalty(status: Column) -> Column:
    return F.when(has(status) & (status != "new"), -C.CONTACTED_PENALTY).otherwise(0)


def clamped(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def effective_segment(segment: Column, model_segment: Column, confidence: Column) -> Column:
    """The model's segment where it is known and confident enough; else the source's."""
    usable = (confidence >= C.MODEL_CONFIDENCE) & model_segment.isin(*C.SEGMENT_POINTS)
    return F.when(F.coalesce(usable, F.lit(False)), model_segment).otherwise(segment)


def describe_segment(segment: Column, model_segment: Column, confidence: Column) -> Column:
    """The segment that the score uses, in words."""
    return strings.segment_label(effective_segment(segment, model_segment, confidence))


def score_leads(leads: DataFrame, profile: C.Profile, today: Column) -> DataFrame:
    """Adds the parts p_segment, p_contact, p_recency, p_city, p_detail, p_penalty and their clamped sum, score.

    Columns read: segment, phone, email, website, why_now_date, city, address, lat, status and, where present,
    model_segment, model_size, model_deadline and model_confidence. Model answers count only from the confidence on.
    """
    col = lambda n, kind="string": F.col(n) if n in leads.columns else F.lit(None).cast(kind)
    confident = F.coalesce(col("model_confidence", "double") >= C.MODEL_CONFIDENCE, F.lit(False))
    segment = effective_segment(F.col("segment"), col("model_segment"), col("model_confidence", "double"))
    size = F.when(confident, points(C.SIZE_POINTS, F.coalesce(col("model_size"), F.lit("unknown")))).otherwise(0)
    date = F.coalesce(F.col("why_now_date"), F.when(confident, col("model_deadline", "date")))
    out = (
        leads.withColumn("p_segment", F.greatest(F.lit(0), F.least(F.lit(30), points(C.SEGMENT_POINTS, segment, C.SEGMENT_POINTS["other"]) + size)))
        .withColumn("p_contact", points(C.CONTACT_POINTS, contact_band(F.col("phone"), F.col("email"), F.col("website"))))
        .withColumn("p_recency", points(C.RECENCY_POINTS, recency_band(date, today)))
        .withColumn("p_city", F.when(strings.city_key(F.col("city")) == strings.city_key(F.lit(profile.city)), C.CITY_MATCH).otherwise(0))
        .withColumn("p_detail", F.when(has(F.col("address")), C.ADDRESS).otherwise(0) + F.when(F.coalesce(col("lat", "double"), F.lit(0.0)).cast("boolean") | has(F.col("website")), C.LOCATION).otherwise(0))
        .withColumn("p_penalty", penalty(F.col("status")))
    )
    return out.withColumn("score", clamped(*(F.col(f"p_{p}") for p in ("segment", "contact", "recency", "city", "detail", "penalty"))))


def score_requirements(rows: DataFrame, profile: C.Profile, today: Column) -> DataFrame:
    """Adds p_deadline, p_fit, p_contact, p_place, p_penalty and score from deadline, quantity_fit, phone, email, contact_name, city, state, status."""
    out = (
        rows.withColumn("p_deadline", points(C.DEADLINE_POINTS, deadline_band(F.col("deadline"), today)))
        .withColumn("p_fit", points(C.FIT_POINTS, F.coalesce(F.col("quantity_fit"), F.lit("unstated")), C.FIT_POINTS["unstated"]))
        .withColumn("p_contact", points(C.REQUIREMENT_CONTACT_POINTS, requirement_contact_band(F.col("phone"), F.col("email"), F.col("contact_name"))))
        .withColumn("p_place", points(C.PLACE_POINTS, place_band(F.col("city"), F.col("state"), profile)))
        .withColumn("p_penalty", penalty(F.col("status")))
    )
    return out.withColumn("score", clamped(*(F.col(f"p_{p}") for p in ("deadline", "fit", "contact", "place", "penalty"))))
