"""Nearest phrase pairs and robots rules against plain loops, and on awkward rows."""

import random
import re

import pytest

from leadloom.config import Profile
from leadloom.operators import matching, proximity, robots

PROFILE = Profile(
    city="Pune", exclude=("cloud kitchen",), produce_words=("vegetables", "provisions", "groceries", "mess", "canteen"), requirement_words=("tender", "supply of", "quotations", "bids", "mess tender"),
    opening_words=("open", "opens", "expands", "inaugurated"), venue_words=("hotel", "restaurant", "hostel", "university"),
)


def brute_nearest(text, first, second, most):
    """The nested loop over all matches: a nearer pair replaces the best; one that overlaps counts 0 and replaces any."""
    every = lambda words: [(m.start(), m.end(), re.sub(r"\s+", " ", m[1]).lower()) for m in re.finditer(matching.phrase_pattern(list(words)).replace("(?iu)", "(?i)"), text)]
    best = None
    for x in every(first):
        for y in every(second):
            gap = y[0] - x[1] if x[0] <= y[0] else x[0] - y[1]
            if gap <= most and (best is None or gap < best[0]):
                best = (max(0, gap), [x[2], y[2]])
    return best


def brute_item(text, profile=PROFILE):
    if re.search("|".join(profile.exclude), text or "", re.I):
        return (False, None, None, [], None, "excluded operating model")
    for rule, tier, a, b, gap in (("demand", "requirement_candidate", profile.produce_words, profile.requirement_words, profile.demand_gap), ("opening", "awareness", profile.opening_words, profile.venue_words, profile.opening_gap)):
        if found := brute_nearest(text or "", a, b, gap):
            return (True, rule, tier, found[1], found[0], None)
    return (False, None, None, [], None, None)


def items(spark, texts):
    rows = [(i, t, "clash", 3, "k") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "id long, text string, kind string, n int, word string")
    return {r["id"]: tuple(r)[1:] for r in proximity.matched_items(table, "id", "text", PROFILE).collect()}


def test_items_say_who_buys(spark):
    texts = [
        "Tender floated for supply of vegetables to the hostel mess", "Quotations invited for canteen provisions at the district hospital", "The city hotel opens in June", "A metro line opens", "Road tender",
        "New cloud kitchen opens: a hotel", None, "", "  ", "MESS TENDER", "Supply\n of   Vegetables", "vegetables" + "x" * 300 + " tender", "vegetables " + "é" * 139 + " tender", "vegetables " + "é" * 138 + " tender",
        "The festival was inaugurated. " + "Troupes came from six states. " * 8 + "The university will host it.", "tender " * 3 + "vegetables " * 3 + "bids",
    ]
    got = items(spark, texts)
    assert got == {i: brute_item(t) for i, t in enumerate(texts)}
    assert got[0][1:3] == ("demand", "requirement_candidate") and got[2][1] == "opening" and not got[3][0] and not got[14][0]
    assert got[9][3:5] == (["mess", "mess tender"], 0)  # one within the other


@pytest.mark.parametrize("seed", range(2))
def test_items_like_the_nested_loop(spark, seed):
    rng = random.Random(seed)
    words = [*PROFILE.produce_words, *PROFILE.requirement_words, *PROFILE.opening_words, *PROFILE.venue_words, "a", "road", "metro", "ünï", "supply", "of"]
    weights = [1] * (len(words) - 6) + [12, 12, 12, 12, 2, 2]
    texts = [rng.choice([" ", "  ", ", ", " \n"]).join(rng.choices(words, weights, k=rng.choice([0, 3, 12, 60, 400]))) for _ in range(80)]
    texts.append(" ".join(rng.choices(words, k=3_000)))  # one long text
    assert items(spark, texts) == {i: brute_item(t) for i, t in enumerate(texts)}


def test_no_items(spark):
    assert proximity.matched_items(spark.createDataFrame([], "id long, text string"), "id", "text", PROFILE).count() == 0


# ---------------------------------------------------------------------------------------


def test_robots_files(spark):
    own = "User-agent: other\nUser-agent: LEADBOT\nDisallow: /a # no\nAllow:/a/b\nCrawl-delay: 2\nDisallow:\n\nUser-agent: *\nDisallow: /\n\nUser-agent: leadbot\nDisallow: /z"
    files = [("own", own), ("star", "junk\r\nUSER-AGENT: *\r\nDisallow: /p:q\r\nuser-agent: x\r\nDisallow: /"), ("none", None), ("empty", ""), ("stray", "Disallow: /\nUser-agent: x\nDisallow: /y")]
    got = {tuple(r) for r in robots.robots_rules(spark.createDataFrame(files, "host string, body string"), "LeadBot").collect()}
    assert got == {("own", "/a", False), ("own", "/a/b", True), ("own", "/z", False), ("star", "/p:q", False)}


def brute_allowed(host, path, rules):
    best = (-1, True)
    for h, pattern, allow in rules:
        if h == host and pattern:
            anchored = pattern.endswith("$")
            regex = ".*".join(map(re.escape, (pattern[:-1] if anchored else pattern).split("*")))
            if re.match(regex + (r"\Z" if anchored else ""), path, re.S):
                best = max(best, (len(pattern), allow))
    return best[1]


def test_paths_like_every_rule_on_every_path(spark):
    rng = random.Random(8)
    piece = lambda k: "".join(rng.choices("ab/.?*$é", [6, 6, 5, 2, 2, 2, 1, 1], k=k))
    hosts = ["hot"] * 6 + ["h1", "h2", "no-rules"]
    rules = [(rng.choice(hosts[:-1]), "/" + piece(rng.randrange(0, 5)), rng.random() < 0.5) for _ in range(150)] + [("hot", "", False), ("h1", "/*$", False), ("h1", "$", True), ("h2", "*b", False)]
    paths = [(rng.choice(hosts), "/" + piece(rng.randrange(0, 7))) for _ in range(700)] + [("hot", "/" + "a" * 3000), ("hot", ""), (None, "/a"), ("hot", None), ("hot", "/a\nb")]
    table = spark.createDataFrame([(*p, 1, "x") for p in paths], "host string, path string, n int, prefix string")
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.allowed_paths(table, spark.createDataFrame(rules, "host string, pattern string, allow boolean")).collect()}
    want = {(h, p): brute_allowed(h, p, rules) for h, p in paths if h is not None and p is not None}
    assert got == want and len(set(want.values())) == 2
