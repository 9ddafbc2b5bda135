"""Answers of a model as text: their JSON, checked fields, and openers of two lines. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from . import strings

#: Characters that an opener's line may have.
OPENER_CHARS = 120
#: Words of advertisement that no opener may use.
ADVERTISING = (
    "excited", "thrilled", "delighted", "leading", "best in", "best-in", "world class", "world-class", "cutting edge", "cutting-edge",
    "synergy", "revolution", "passionate", "premier", "unparalleled", "partner with you",
)
#: What may stand around a line of an opener, and before it.
AROUND, LIST_MARKS = " \t\r`\"'“”", "-*>"
#: Ranges of code points that hold pictographs.
PICTOGRAPHS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


def extract_json(text: Column) -> Column:
    """The JSON of an answer as a variant: fenced, bare, or from the first brace to the last; null if none of them parses."""
    braces = lambda c: strings.blank_to_null(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    fenced = lambda raw: strings.blank_to_null(F.trim(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)))
    parsed = lambda raw, inner: F.coalesce(*(F.try_parse_json(c) for c in (inner, braces(inner), strings.blank_to_null(raw), braces(raw))))
    return strings.once(F.trim(F.coalesce(text, F.lit(""))), lambda raw: strings.once(fenced(raw), lambda inner: parsed(raw, inner)))


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _clipped(c: Column, limit: int) -> Column:
    return F.rtrim(F.substring(strings.squeeze(c), 1, limit))


def _some(c: Column, limit: int) -> Column:
    """Squeezed and cut; null where nothing is left."""
    return strings.blank_to_null(_clipped(c, limit))


def _list(v: Column, path: str, many: int, limit: int) -> Column:
    """The first strings of a list that say something; members of other kinds are passed over."""
    members = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(members, lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string")))
    return F.transform(F.slice(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != "")), 1, many), lambda t: _clipped(t, limit))


def _checked(v: Column, problems: list[Column], fields: list[Column]) -> Column:
    is_object = _kind(v, "$").startswith("OBJECT")
    said = F.array_join(F.filter(F.array(*problems), lambda p: p.isNotNull()), "; ")
    reason = F.when(v.isNull(), "reply is not JSON").when(~is_object, "reply is not a JSON object").when(said != "", said)
    return strings.once(reason, lambda why: F.struct(why.isNull().alias("ok"), why.alias("reason"), *(F.when(why.isNull(), f).alias(n) for n, f in fields)))


def _confidence(v: Column) -> tuple[Column, Column]:
    number = _kind(v, "$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(v, "$.confidence", "double")))
    return F.when(~number, "confidence is missing or not a number"), value


def _deadline(v: Column) -> tuple[Column, Column]:
    """An ISO date of the calendar; anything else that was given is reported as dropped."""
    said = F.try_variant_get(v, "$.deadline", "string")
    date = F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(said, "yyyy-MM-dd"))
    return date, F.when(said.isNotNull() & date.isNull(), _clipped(said, 40))


def parse_enrich(text: Column) -> Column:
    """struct(ok, reason, segment, size, buys, quantity, deadline, deadline_dropped, evidence, confidence).

    Segment, size and confidence must be there, and the first two among the known values; a confidence out of range
    is clamped; lists hold 8 and 4 members at most.
    """
    return strings.once(extract_json(text), _enrich)


def _enrich(v: Column) -> Column:
    no_confidence, confidence = _confidence(v)
    date, dropped = _deadline(v)
    problems = []
    for name in ("segment", "size"):
        problems.append(F.when(_kind(v, f"$.{name}") != "STRING", f"{name} is missing or not a string"))
    problems.append(no_confidence)
    for name, known in (("segment", C.SEGMENT_POINTS), ("size", C.SIZE_POINTS)):
        value = _string(v, f"$.{name}")
        problems.append(F.when((value != "") & ~value.isin(*known), F.concat(F.lit(f'{name} "'), _clipped(value, 40), F.lit('" is not one of the listed values'))))
    fields = [
        ("segment", _string(v, "$.segment")), ("size", _string(v, "$.size")), ("buys", _list(v, "$.buys", 8, 60)), ("quantity", _some(_string(v, "$.quantity"), 120)),
        ("deadline", date), ("deadline_dropped", dropped), ("evidence", _list(v, "$.evidence", 4, 120)), ("confidence", confidence),
    ]
    return _checked(v, problems, fields)


def parse_requirement(text: Column) -> Column:
    """struct(ok, reason, is_requirement, organisation, city, requirement, quantity, deadline, deadline_dropped, contact_hint, site, evidence, confidence); only is_requirement and confidence must be there."""
    return strings.once(extract_json(text), _requirement)


def _requirement(v: Column) -> Column:
    no_confidence, confidence = _confidence(v)
    date, dropped = _deadline(v)
    problems = [F.when(_kind(v, "$.is_requirement") != "BOOLEAN", "is_requirement is missing or not true/false"), no_confidence]
    limits = {"organisation": 160, "city": 80, "requirement": 200, "quantity": 120, "contact_hint": 120, "site": 200}
    texts = {n: _some(_string(v, f"$.{n}"), limit) for n, limit in limits.items()}
    fields = [
        ("is_requirement", F.try_variant_get(v, "$.is_requirement", "boolean")), *((n, texts[n]) for n in ("organisation", "city", "requirement", "quantity")),
        ("deadline", date), ("deadline_dropped", dropped), ("contact_hint", texts["contact_hint"]), ("site", texts["site"]), ("evidence", _list(v, "$.evidence", 4, 120)), ("confidence", confidence),
    ]
    return _checked(v, problems, fields)


def parse_opener(text: Column) -> Column:
    """struct(ok, reason, opener): the first two lines that say something, each short, without advertising and pictographs.

    Fences, list marks and quotes around a line say nothing. The reason is the first that holds, in the order of
    the list below.
    """
    unfenced = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s*```\w*", ""))
    said = F.filter(F.transform(unfenced, lambda x: F.ltrim(F.rtrim(x, F.lit(AROUND)), F.lit(AROUND + LIST_MARKS))), lambda x: x != "")
    return strings.once(said, _opener)


def _opener(said: Column) -> Column:
    opener = F.slice(said, 1, 2)
    over = F.get(F.filter(F.transform(opener, F.length), lambda n: n > OPENER_CHARS), F.lit(0))
    holds = lambda pattern: F.array_join(opener, "\n").rlike(pattern)
    reasons = [
        (F.size(said) < 2, F.concat(F.lit("expected two lines, got "), F.size(said).cast("string"))),
        (over.isNotNull(), F.concat(F.lit("a line is "), over.cast("string"), F.lit(f" characters, over the {OPENER_CHARS} limit"))),
        (holds(r"(?i)\b(?:" + "|".join(ADVERTISING) + r")\b"), F.lit("the reply uses marketing language")),
        (holds(PICTOGRAPHS), F.lit("the reply contains an emoji")),
    ]
    reason = F.coalesce(*(F.when(wrong, why) for wrong, why in reasons))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), F.array_join(opener, "\n")).alias("opener"))
