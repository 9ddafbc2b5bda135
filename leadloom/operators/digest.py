"""Digests of all cities at once: ranks, block lengths and the plan that fits are columns; only full sheets are long."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dedupe, ranking, scans

#: Sections in their order, with letter, heading and kinds.
SECTIONS = (("requirements", "R", "REQUIREMENTS POSTED", ("requirement",)), ("buyers", "L", "BUYERS TO APPROACH", ("buyer", "tender", "signal")), ("registrations", "G", "WHERE TO REGISTER", ("registration",)))
#: Sentences of a digest.
FOOTER = "Reply with R<n>/L<n>/G<n> won/lost/contacted to update."
NO_LEADS = "No new leads today."
NO_REQUIREMENT = "No requirement was posted anywhere we can read today."
#: Lines that a block may have: what it is, why now, whom to ask.
LINES = 3


def _sectioned(leads: DataFrame) -> DataFrame:
    """New leads of the sections with section (its letter), nth (its place in the order), and lines; a missing city is ''."""
    said = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs if c in leads.columns), F.lit(None).cast("string"))
    by_kind = F.create_map(*[F.lit(x) for n, (_, letter, _, kinds) in enumerate(SECTIONS) for kind in kinds for x in (kind, f"{n}{letter}")])
    at = F.try_element_at(by_kind, F.col("kind"))
    new = leads.where("status = 'new'").where(at.isNotNull())
    first = F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit(")"))
    return new.select(
        F.coalesce(F.col("city") if "city" in leads.columns else F.lit(None), F.lit("")).alias("city"), F.substring(at, 1, 1).cast("int").alias("nth"), F.substring(at, 2, 1).alias("section"), "id", "score", F.coalesce("segment", F.lit("other")).alias("segment"),
        F.array(first, said("why_now"), said("contact", "phone", "email")).alias("lines"), said("contact", "phone", "email").isNotNull().alias("reachable"),
    )


def _block(label: Column, lines: Column, n: Column | int) -> Column:
    """The first n lines, without those that say nothing."""
    return F.concat(label, F.lit(" "), F.array_join(F.slice(lines, 1, n), "\n"))


def shown(leads: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The leads that each section of each city may show, with place, label and, for 1 to 3 lines, block and the running length of blocks.

    Ranked by score; of equal scores the segment that has had fewer places goes first. Every group is limited in
    each task before the shuffle: a lead beyond the first `cap` of its segment has `cap` others before it.
    """
    cap = F.create_map(*[F.lit(x) for name, letter, _, _ in SECTIONS for x in (letter, caps.get(name, 0))])[F.col("section")]
    most = max((caps.get(name, 0) for name, *_ in SECTIONS), default=0)
    turns = ranking.top_per(_sectioned(leads), ["city", "section", "segment"], [F.desc("score"), "id"], most, "turn")
    top = ranking.top_per(turns, ["city", "section"], [F.desc("score"), "turn", "id"], most).where(F.col("place") <= cap)
    labelled = top.withColumn("label", F.concat("section", F.col("place").cast("string")))
    blocks = labelled.withColumn("blocks", F.array(*(_block(F.col("label"), F.col("lines"), n + 1) for n in range(LINES))))
    upto = Window.partitionBy("city", "section").orderBy("place")  # no more rows than the cap
    return blocks.withColumn("upto", F.array(*(F.sum(F.length(F.col("blocks")[n]) + 1).over(upto) for n in range(LINES))))


class _Section(NamedTuple):
    """A section of a city as columns: what it may show, of how many, under which heading."""

    rows: Column
    total: Column
    heading: str

    def head(self, n: Column) -> Column:
        """'\\nHEADING (n of total)', or nothing where it shows none."""
        of = F.when(self.total > n, F.concat(F.lit(" of "), self.total.cast("string"))).otherwise("")
        return F.when(n > 0, F.concat(F.lit(f"\n{self.heading} ("), n.cast("string"), of, F.lit(")"))).otherwise("")

    def size(self, n: Column, lines: Column) -> Column:
        return F.length(self.head(n)) + F.coalesce(F.get(F.get(self.rows, n - 1)["upto"], lines - 1), F.lit(0))

    def text(self, n: Column, lines: Column) -> Column:
        return F.concat(self.head(n), F.array_join(F.transform(F.slice(self.rows, 1, n), lambda r: F.concat(F.lit("\n"), F.get(r["blocks"], lines - 1))), ""))


def _plan(step: Column, most: tuple[Column, Column, Column]) -> dict[str, Column]:
    """What the digest shows after `step` concessions.

    Each requirement layout, from wide to narrow, has one round of them: first buyers get narrower, then registrations
    leave from the end, then buyers do. After the last round requirements leave.
    """
    r, b, g = most
    round_ = b + g + LINES
    spent = LINES * round_ - 1
    within = F.when(step > spent, round_ - 1).otherwise(step % round_)
    left = lambda n, conceded: n - F.least(n, F.greatest(F.lit(0), conceded))
    return {
        "r_lines": LINES - F.least(F.lit(LINES - 1), (step / round_).cast("int")), "b_lines": LINES - F.least(F.lit(LINES - 1), within), "r": left(r, step - spent), "b": left(b, within - (LINES - 1) - g), "g": left(g, within - (LINES - 1)),
    }


def digests(leads: DataFrame, caps: dict[str, int], title: str, max_chars: int = 1500) -> DataFrame:
    """One row a city: city, text within max_chars, index (label to id), shown, considered, requirements_considered, with_contact, r_lines, b_lines.

    caps: most rows of requirements, buyers, registrations. Of the concessions the fewest that make the text fit; a text
    that still is too long is cut. A city without new leads is told so. The counts are over all new leads of the
    city, with_contact over its requirements.
    """
    sectioned = _sectioned(leads)
    of = lambda letter: F.count(F.when(F.col("section") == letter, 1)).cast("int")
    counts = sectioned.groupBy("city").agg(of("R").alias("n_R"), of("L").alias("n_L"), of("G").alias("n_G"), F.count(F.when((F.col("section") == "R") & F.col("reachable"), 1)).cast("int").alias("with_contact"))
    rows = shown(leads, caps).groupBy("city").agg(*(F.array_sort(F.collect_list(F.when(F.col("section") == letter, F.struct("place", "label", "id", "blocks", "upto")))).alias(letter) for _, letter, _, _ in SECTIONS))  # no more than the caps
    cities = leads.select(F.coalesce("city", F.lit("")).alias("city")).distinct()
    each = cities.join(counts, "city", "left").join(rows, "city", "left")
    parts = [_Section(F.col(letter), F.coalesce(f"n_{letter}", F.lit(0)), heading) for _, letter, heading, _ in SECTIONS]
    sizes = tuple(F.greatest(F.lit(0), F.coalesce(F.size(p.rows), F.lit(0))) for p in parts)
    each = each.select("city", *(F.coalesce(letter, F.array()).alias(letter) for _, letter, _, _ in SECTIONS), *(p.total.alias(f"n_{letter}") for p, (_, letter, _, _) in zip(parts, SECTIONS, strict=True)), F.coalesce("with_contact", F.lit(0)).alias("with_contact"), *(s.alias(f"may_{letter}") for s, (_, letter, _, _) in zip(sizes, SECTIONS, strict=True)))
    most = (F.col("may_R"), F.col("may_L"), F.col("may_G"))
    head = F.concat(F.lit(title), F.when(F.col("city") != "", F.concat(F.lit(" - "), "city")).otherwise(""))

    def around(p: dict[str, Column]) -> Column:
        """What follows the sections."""
        nothing = F.when(p["r"] + p["b"] + p["g"] == 0, "\n" + NO_LEADS).otherwise("")
        return F.concat(nothing, F.when(F.col("n_R") == 0, "\n" + NO_REQUIREMENT).otherwise(""), F.lit("\n" + FOOTER))

    def length(step: Column) -> Column:
        p = _plan(step, most)
        return F.length(head) + parts[0].size(p["r"], p["r_lines"]) + parts[1].size(p["b"], p["b_lines"]) + parts[2].size(p["g"], F.lit(1)) + F.length(around(p))

    last = LINES * (most[1] + most[2] + LINES) - 1 + most[0]
    fits = F.get(F.filter(F.sequence(F.lit(0), last), lambda step: length(step) <= max_chars), F.lit(0))
    planned = each.withColumn("step", F.coalesce(fits, last))
    planned = planned.select("*", *(c.alias(f"p_{k}") for k, c in _plan(F.col("step"), most).items()))
    p = {k: F.col(f"p_{k}") for k in ("r", "b", "g", "r_lines", "b_lines")}
    text = F.concat(head, parts[0].text(p["r"], p["r_lines"]), parts[1].text(p["b"], p["b_lines"]), parts[2].text(p["g"], F.lit(1)), around(p))
    pairs = F.concat(*(F.transform(F.slice(s.rows, 1, n), lambda r: F.struct(r["label"], r["id"].cast("string"))) for s, n in zip(parts, (p["r"], p["b"], p["g"]), strict=True)))
    return planned.select(
        "city", F.substring(text, 1, max_chars).alias("text"), F.map_from_entries(pairs).alias("index"), (p["r"] + p["b"] + p["g"]).alias("shown"), (F.col("n_R") + F.col("n_L") + F.col("n_G")).alias("considered"), F.col("n_R").alias("requirements_considered"), "with_contact",
        p["r_lines"].alias("r_lines"), p["b_lines"].alias("b_lines"),
    )


def full_sheets(leads: DataFrame) -> DataFrame:
    """(city, section, position, id, block): every new lead of every city with all its lines, in the digest's order; positions count over ranges, so no city is one task."""
    order = [F.col("nth"), F.desc("score"), F.col("turn"), F.col("id")]
    turns = scans.ordinals(_sectioned(leads), [F.desc("score"), F.asc("id")], "turn", ["city", "section", "segment"])
    placed = scans.ordinals(turns, order, "position", ["city"])
    placed = scans.ordinals(placed, [F.asc("position")], "place", ["city", "section"])
    return placed.select("city", "section", "position", "id", _block(F.concat("section", F.col("place").cast("string")), F.col("lines"), LINES).alias("block"))


def write_digests(leads: DataFrame, caps: dict[str, int], title: str, path: str, max_chars: int = 1500) -> None:
    """Under `path`, in a folder for each city: texts, index (JSON lines of label and id) and the full sheet in its order."""
    made = digests(leads, caps, title, max_chars)
    made.select("city", F.col("text").alias("value")).write.mode("overwrite").partitionBy("city").text(f"{path}/text")
    made.select("city", F.explode("index").alias("label", "id")).write.mode("overwrite").partitionBy("city").json(f"{path}/index")
    sheet = full_sheets(leads).repartitionByRange("city", "position").sortWithinPartitions("city", "position")
    sheet.select("city", F.col("block").alias("value")).write.mode("overwrite").partitionBy("city").text(f"{path}/full")


def digest(leads: DataFrame, caps: dict[str, int], max_chars: int = 1500) -> tuple[str, dict[str, str]]:
    """(text, label to id) over all cities; caps by kind. One row reaches the driver."""
    by_section = {name: sum(caps.get(k, 0) for k in kinds) for name, _, _, kinds in SECTIONS}
    rows = digests(leads.withColumn("city", F.lit("")), by_section, "Leads", max_chars).take(1)
    return (rows[0]["text"], rows[0]["index"]) if rows else (NO_LEADS, {})


def combined(leads: DataFrame, per_city: int) -> DataFrame:
    """Leads of several cities, each once, the best of every city, ranked anew."""
    once = dedupe.keep_first(leads, ["id"], ["ord"])
    return ranking.diversified(ranking.top_per(once, ["city"], [F.desc("score"), "id"], per_city, "in_city"))
