"""Quotation linking: reply-ordered conversations without quotes. DataFrame and SQL functions only.

Lines that start with > marks are quotes, the number of marks is their level. Runs of one level are passages.
Their normalised text, as a whole, by paragraph and by line, is hashed and joined to the hashes of what earlier
messages of the conversation say themselves. The first message that says it is its original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: A single line must have so many words to stand for a quotation.
LINE_WORDS = 3
_MARKS = r"^\\s*((?:>\\s?)+)"

#: Lines as (level, content): the marks are cut off.
_LINES = rf"""transform(split(coalesce(text, ''), '\\r?\\n', -1), l -> named_struct(
    'level', char_length(regexp_replace(regexp_extract(l, '{_MARKS}', 1), '[^>]', '')),
    'content', regexp_replace(l, '{_MARKS}', '')))"""

#: Where runs of lines of one level start, from 1; and the runs, each a slice of the lines up to the next start.
_STARTS = "filter(sequence(1, size(levels)), i -> i = 1 OR levels[i - 1] <> levels[i - 2])"
_RUNS = """transform(starts, (s, k) -> named_struct('level', levels[s - 1], 'content',
    slice(contents, s, coalesce(get(starts, k + 1), size(levels) + 1) - s)))"""


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _units(lines: str) -> str:
    """SQL: (weight, hash) of the whole, each paragraph and each longer line of an array of lines."""
    joined = f"array_join({lines}, '\\n')"
    whole = f"array(named_struct('weight', 3, 'said', {_normal(joined)}))"
    paragraphs = f"transform(split({joined}, '\\n\\\\s*\\n'), p -> named_struct('weight', 2, 'said', {_normal('p')}))"
    single = f"filter(transform({lines}, l -> named_struct('weight', 1, 'said', {_normal('l')})), u -> size(split(u.said, ' ')) >= {LINE_WORDS})"
    return f"transform(filter(concat({whole}, {paragraphs}, {single}), u -> u.said <> ''), u -> named_struct('weight', u.weight, 'hash', sha2(u.said, 256)))"


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Adds body (the text without its quotes, trimmed), said (hashed units of it) and passages (level, hashed units)."""
    runs = messages.withColumn("lines", F.expr(_LINES)).withColumns({"levels": F.expr("transform(lines, l -> l.level)"), "contents": F.expr("transform(lines, l -> l.content)")})
    runs = runs.withColumn("starts", F.expr(_STARTS)).withColumn("runs", F.expr(_RUNS)).drop("lines", "levels", "contents", "starts")
    own = "flatten(transform(filter(runs, r -> r.level = 0), r -> r.content))"
    said = f"flatten(transform(filter(runs, r -> r.level = 0), r -> {_units('r.content')}))"
    quoted = f"transform(filter(runs, r -> r.level > 0), r -> named_struct('level', r.level, 'units', {_units('r.content')}))"
    out = runs.withColumn("body", F.expr(f"trim(BOTH '\\n \\t\\r' FROM array_join({own}, '\\n'))"))
    # The whole of all own runs is a unit too, for quotes of messages that themselves quote in between.
    out = out.withColumn("said", F.expr(f"concat(array(named_struct('weight', 3, 'hash', sha2({_normal('body')}, 256))), {said})"))
    return out.withColumn("passages", F.expr(quoted)).drop("runs")


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of every message that replies, by doubling of pointers."""
    at = materialize(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "pointers")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        step = at.join(up, ["conv_id", "root"], "left")
        step = step.select("conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved"))
        step = materialize(step, "pointers")
        at = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            return at


def link_quotations(messages: DataFrame) -> DataFrame:
    """Reply-ordered messages without quotes: conv_id, turn, role, text, n_passages, n_linked, reply_to, root, depth.

    A passage links to the first message of its conversation that says its whole, else one of its paragraphs, else
    one of its lines of LINE_WORDS words or more, if that message is earlier. A message replies to the latest
    original of its passages of the lowest level that links; without one it starts a thread (reply_to null, depth
    0, root its own turn). Rows are sorted by conv_id, root and turn, so originals precede replies. One row per
    input row. Null texts are empty; null conv_ids or turns link with nothing; rows that repeat a turn share
    its links; further columns are ignored.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    parsed = materialize(parse_quotes(rows), "messages")
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.where("size(passages) > 0").select("conv_id", "turn", F.posexplode("passages").alias("nth", "p"))
    units = quoted.select("conv_id", "turn", "nth", "p.level", F.explode("p.units").alias("u")).select("conv_id", "turn", "nth", "level", "u.weight", "u.hash").distinct()
    units = materialize(units, "units")
    # Only hashes that some passage asks for; then one row for each, whoever repeats it.
    said = known.select("conv_id", "turn", F.explode("said").alias("u")).select("conv_id", "turn", "u.hash")
    first = materialize(said.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")), "originals")
    links = units.join(first, ["conv_id", "hash"]).where("original < turn")
    passages = links.groupBy("conv_id", "turn", "nth", "level").agg(F.max(F.struct("weight", "original")).alias("m")).select("conv_id", "turn", "level", "m.original")
    best = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("original")).alias("back"))).alias("m"))
    replies = materialize(best.select("conv_id", "turn", "n_linked", (-F.col("m.back")).alias("reply_to")), "replies")
    linked = replies.join(_roots(replies), ["conv_id", "turn"])
    out = parsed.select("conv_id", "turn", "role", F.col("body").alias("text"), F.size("passages").cast("long").alias("n_passages"))
    out = out.join(materialize(linked, "linked"), ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("conv_id", "turn", "role", "text", "n_passages", zero("n_linked"), "reply_to", F.coalesce("root", "turn").alias("root"), zero("depth"))
    return out.orderBy("conv_id", "root", "turn")


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))
