"""Secret scan with corpus-wide ownership frequency. DataFrame and SQL functions only.

Candidates are regex matches. Each candidate's value is hashed, and the hash is counted over the distinct
repositories and distinct owners of the whole corpus: a value that many owners hold, or that two owners hold in many
repositories, is a widely copied example; a value that one owner holds looks live, in however many of its
repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Fixed by the contract of the scan; in this order at equal starts. The value is the first group.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
#: The scan's own kind: long runs that mix cases and digits, like keys in base 64.
GENERIC = r"([A-Za-z0-9+/_=-]{20,})"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("generic", GENERIC))
OWN = 3

#: A value is a widely copied example from so many owners on, or from two owners and so many repositories on.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 20
#: Matches whose places are summed together.
STRETCH = 256
#: Characters of a slice of a text that is masked.
CHUNK = 4096
MASK = "<secret>"

_SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found_sql(rank: int, pattern: str) -> str:
    """SQL: all matches in __t, leftmost and non-overlapping, as spans in code points.

    The pieces between the matches and the matches themselves alternate, so their lengths give the places. Places are
    summed within stretches of matches, then over the stretches: no list grows by one for every match of a text.
    """
    p = _quoted(pattern)
    none = f"cast(array() AS array<{_SPAN}>)"
    return f"""CASE WHEN rlike(__t, {p}) THEN flatten(transform(aggregate(
        transform(transform(array(zip_with(regexp_extract_all(__t, {p}, 0), split(__t, {p}, -1), (h, g) -> named_struct('hit', h, 'gap', g))),
            z -> transform(sequence(0, (size(z) - 1) div {STRETCH}), k -> slice(z, cast(k * {STRETCH} + 1 AS int), {STRETCH})))[0],
        part -> aggregate(part, named_struct('at', 0L, 'out', {none}),
            (a, x) -> IF(x.hit IS NULL, a, named_struct(
                'at', a.at + char_length(x.gap) + char_length(x.hit),
                'out', concat(a.out, array(named_struct('start', a.at + char_length(x.gap), 'rank', {rank}, 'end', a.at + char_length(x.gap) + char_length(x.hit), 'value', regexp_extract(x.hit, {p}, 1)))))))),
        named_struct('at', 0L, 'all', cast(array() AS array<struct<at:bigint,spans:array<{_SPAN}>>>)),
        (a, x) -> named_struct('at', a.at + x.at, 'all', concat(a.all, array(named_struct('at', a.at, 'spans', x.out)))),
        a -> a.all),
        x -> transform(x.spans, s -> named_struct('start', s.start + x.at, 'rank', s.rank, 'end', s.end + x.at, 'value', s.value))))
        ELSE {none} END"""


def _searched(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """(row, text, repo, owner, base, own): each row as it is, carried whole, with the spans of its text by kind.

    `own` holds the scan's own matches, those that overlap base spans too.
    """
    base = "filter(" + _found_sql(0, ASSIGN) + ", s -> char_length(s.value) >= 6)"
    own = f"filter({_found_sql(3, GENERIC)}, s -> rlike(s.value, '[A-Z]') AND rlike(s.value, '[a-z]') AND rlike(s.value, '[0-9]'))"
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = docs.select(F.struct("*").alias("row"), named("text").alias("__t"), named(repository).alias("repo"), named(owner).alias("owner"))
    out = out.select("row", "repo", "owner", F.expr(f"concat({base}, {_found_sql(1, ACCESS)}, {_found_sql(2, HEX)})").alias("base"), F.expr(own).alias("own"), "__t")
    return out.withColumnRenamed("__t", "text")


def _judged(rows: DataFrame) -> DataFrame:
    """(uid, start, rank, end, owners, repositories) of each span, from (uid, repo, owner, base, own).

    The scan's own spans that overlap a base span are left out: one pass over a text's spans in order tells how far the
    base spans that start before an own one's end reach. Values are counted by (value, owner, repository), then
    (value, owner), then value, each step combined before its shuffle. Hot values meet their counts in a plain join,
    which adaptive execution splits.
    """
    each = rows.select("uid", "repo", "owner", F.explode(F.concat("base", "own")).alias("c")).select("uid", "repo", "owner", "c.*")
    own = F.col("rank") == OWN
    # An own span asks at its end, a base span answers from its start on; asking comes first where both are at one place.
    place = Window.partitionBy("uid").orderBy(F.when(own, F.col("end")).otherwise(F.col("start")), F.when(own, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~own, F.col("end"))).over(place)
    each = each.withColumn("reach", reach).where(~own | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")
    each = materialize(each.withColumn("hash", F.sha2("value", 256)).drop("value"), "each")
    pairs = each.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counts = materialize(pairs.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")), "owners")
    return each.join(counts, "hash").select("uid", "start", "rank", "end", "owners", "repositories")


def _joined_sql(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k, _ in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({kinds}), s.rank + 1), s.start, s.end)), ',')"


def _copied_sql(copied_owners: int, copied_repositories: int, of: str = "s.") -> str:
    return f"({of}owners >= {copied_owners} OR ({of}owners >= 2 AND {of}repositories >= {copied_repositories}))"


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Spans of whole texts: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, max_owners, max_repositories.

    One row per input row. Unless told otherwise, a document is a repository of its own, named by its doc_id, and its
    source is the owner. Null texts count as empty; texts without matches have spans '' and the hash of ''.
    Null repositories and owners count as one unnamed one. Repeated rows of one repository and owner count
    once in the ownership; ties between kinds at one start go by the order of KINDS. n_live counts spans whose
    value one owner holds, n_copied those of widely copied values; max_owners and max_repositories belong to the most
    widespread of the text's values, 0 without spans. Further columns are ignored.
    """
    given = _searched(docs, repository, owner).select(F.col("row.doc_id").alias("doc_id"), "repo", "owner", "base", "own")
    rows = materialize(given.withColumn("uid", F.monotonically_increasing_id()), "spans")  # so the ids hold from here on
    hit = rows.where("size(base) > 0 OR size(own) > 0")
    judged = _judged(hit).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "owners", "repositories"))).alias("j"))
    out = rows.select("uid", "doc_id").join(judged, "uid", "left").withColumn("j", F.expr("coalesce(j, array())"))
    count = lambda condition: F.expr(f"cast(size(filter(j, s -> {condition})) AS bigint)")
    return out.select(
        "doc_id",
        count("s.rank = 0").alias("n_assign"),
        count("s.rank = 1").alias("n_access"),
        count("s.rank = 2").alias("n_hex"),
        F.sha2(F.expr(_joined_sql(f"filter(j, s -> s.rank < {OWN})")), 256).alias("base_sha256"),
        F.expr(_joined_sql("j")).alias("spans"),
        count("s.owners = 1").alias("n_live"),
        count(_copied_sql(copied_owners, copied_repositories)).alias("n_copied"),
        *(F.expr(f"coalesce(array_max(transform(j, s -> s.{c})), 0L)").alias(f"max_{c}") for c in ("owners", "repositories")),
    )


def _masked(texts: DataFrame, spans: DataFrame, mask: str) -> DataFrame:
    """(uid, text) of the texts that have spans (uid, start, end), each stretch of overlapping ones replaced by the mask.

    Texts are cut into slices of CHUNK characters, so a slice costs what it holds, however many spans its text has, and
    one long text is dealt over tasks.
    """
    order = Window.partitionBy("uid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    runs = spans.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("uid", "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    parts = runs.select("uid", "lo", "hi", F.explode(F.expr(f"sequence(lo div {CHUNK}, (hi - 1) div {CHUNK})")).alias("slice"))
    parts = parts.select("uid", "slice", F.expr(f"struct(greatest(0L, lo - slice * {CHUNK}) AS lo, least({CHUNK}L, hi - slice * {CHUNK}) AS hi, lo >= slice * {CHUNK} AS first)").alias("p"))
    parts = parts.groupBy("uid", "slice").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    slices = texts.select("uid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("slice", "piece")).withColumn("slice", F.col("slice").cast("long"))
    kept = F.expr(f"""aggregate(coalesce(parts, array()), named_struct('at', 0L, 'out', ''),
        (a, p) -> named_struct('at', p.hi, 'out', concat(a.out, substring(piece, cast(a.at + 1 AS int), cast(p.lo - a.at AS int)), IF(p.first, {_quoted(mask)}, ''))),
        a -> concat(a.out, substring(piece, cast(a.at + 1 AS int))))""")
    done = slices.join(parts, ["uid", "slice"], "left").select("uid", F.struct("slice", kept.alias("kept")).alias("s"))
    return done.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["kept"]), "").alias("text"))


def redact_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, mask: str = MASK) -> DataFrame:
    """The rows and columns of `docs`, with every span masked whose value is no widely copied example.

    Texts are searched once. Those without a span to mask, null and empty ones included, pass unchanged.
    Overlapping spans are masked once. Widely copied examples stay. n_chars, where present, is counted anew. Rows are
    carried whole, so columns of any name pass.
    """
    given = materialize(_searched(docs, repository, owner).withColumn("uid", F.monotonically_increasing_id()), "searched")
    hit = given.where("size(base) > 0 OR size(own) > 0")
    spans = materialize(_judged(hit.select("uid", "repo", "owner", "base", "own")).where(~F.expr(_copied_sql(copied_owners, copied_repositories, ""))).select("uid", "start", "end"), "live")
    live = spans.select("uid").distinct()
    texts = materialize(_masked(hit.select("uid", "text").join(live, "uid"), spans, mask).withColumnRenamed("text", "masked"), "masked")
    plain = given.where("size(base) = 0 AND size(own) = 0").select("row.*")
    met = hit.select("uid", "row").join(texts, "uid", "left")
    made = {"text": F.coalesce("masked", "row.text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("masked").isNotNull(), F.char_length("masked")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(met.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)))


def op7_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _oracle_found(rank: int, pattern: str, keep: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    hits, gaps = f"regexp_extract_all(t, {p})", f"regexp_split_to_array(t, {p})"
    before = f"list_sum(list_transform({gaps}[:i], lambda x: len(x))) + coalesce(list_sum(list_transform({hits}[:i - 1], lambda x: len(x))), 0)"
    return f"""list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{'start': CAST({before} AS BIGINT), 'rank': {rank}, 'end': CAST({before} + len({hits}[i]) AS BIGINT), 'value': regexp_extract({hits}[i], {p}, 1)}}), lambda s: {keep})"""


def _oracle_joined(spans: str) -> str:
    return f"coalesce(list_aggregate(list_transform({spans}, lambda s: ['assign', 'access', 'hex', 'generic'][s.rank + 1] || ':' || s.start || ':' || s.end), 'string_agg', ','), '')"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t, row_number() OVER () AS uid FROM documents),
b AS (SELECT *, list_concat(list_concat({_oracle_found(0, ASSIGN, "len(s.value) >= 6")}, {_oracle_found(1, ACCESS, "true")}), {_oracle_found(2, HEX, "true")}) AS base FROM d),
g AS (SELECT *, {_oracle_found(3, GENERIC, "regexp_matches(s.value, '[A-Z]') AND regexp_matches(s.value, '[a-z]') AND regexp_matches(s.value, '[0-9]')")} AS own FROM b),
c AS (SELECT doc_id, owner, uid, list_sort(list_concat(base, list_filter(own, lambda s: len(list_filter(base, lambda b: b.start < s."end" AND s.start < b."end")) = 0))) AS c FROM g),
e AS (SELECT doc_id, owner, uid, unnest(c).value AS v FROM c),
n AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, coalesce(CAST(doc_id AS VARCHAR), ''))) AS repositories FROM e GROUP BY v),
j AS (SELECT uid, CAST(count(*) FILTER (owners = 1) AS BIGINT) AS live, max(owners) AS most_owners, max(repositories) AS most_repositories,
  CAST(count(*) FILTER (owners >= {COPIED_OWNERS} OR (owners >= 2 AND repositories >= {COPIED_REPOSITORIES})) AS BIGINT) AS copied FROM e JOIN n USING (v) GROUP BY uid)
SELECT doc_id, CAST(len(list_filter(c, lambda s: s.rank = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(c, lambda s: s.rank = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(c, lambda s: s.rank = 2)) AS BIGINT) AS n_hex, sha256({_oracle_joined("list_filter(c, lambda s: s.rank < 3)")}) AS base_sha256,
  {_oracle_joined("c")} AS spans, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied,
  coalesce(most_owners, 0) AS max_owners, coalesce(most_repositories, 0) AS max_repositories
FROM c LEFT JOIN j USING (uid)
"""
