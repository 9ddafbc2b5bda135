"""Queries over texts, pages and files: items that say who buys, paths that robots rules allow, PDFs read by streams."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Profile
from ..functions import quantity
from ..operators import proximity, robots
from ..sources import pdf
from .tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Words that the documents hold, in the places of a client's: what is bought, how it is asked for, what opens, and where.
WORDS = Profile(
    city="", exclude=("do not redistribute", "spam"), produce_words=("license", "licensed", "password", "api key", "token"), requirement_words=("the", "of the", "and", "under"),
    opening_words=("mail", "call", "contact", "http"), venue_words=("or", "the", "at", "for"), demand_gap=40, opening_gap=25,
)


def _listed(words) -> str:
    return "(?i)\\b(" + "|".join(sorted(words, key=lambda w: (-len(w), w))).replace(" ", "\\s+") + ")\\b"


def _offsets(kind: str, words) -> str:
    """Every match with its offsets, by a running sum over the pieces of the text."""
    hits, gaps = f"regexp_extract_all(text, '{_listed(words)}')", f"regexp_split_to_array(text, '{_listed(words)}')"
    rows = f"SELECT doc_id, unnest({hits}) AS hit, unnest({gaps}[:len({hits})]) AS gap, unnest(range(len({hits}))) AS n FROM given"
    return f"""{kind} AS (SELECT doc_id, n, lower(regexp_replace(hit, '\\s+', ' ', 'g')) AS word, e - len(hit) AS s, e FROM
  (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM ({rows})))"""


def _nearest(name: str, a: str, b: str, gap: int) -> str:
    """All pairs of a text, kept by distance, then order."""
    return f"""{name} AS (SELECT doc_id, a.word || '|' || b.word AS keywords, greatest(0, CASE WHEN a.s <= b.s THEN b.s - a.e ELSE a.s - b.e END) AS gap,
  row_number() OVER (PARTITION BY doc_id ORDER BY greatest(-1, CASE WHEN a.s <= b.s THEN b.s - a.e ELSE a.s - b.e END), CASE WHEN (CASE WHEN a.s <= b.s THEN b.s - a.e ELSE a.s - b.e END) < 0 THEN -a.n ELSE a.n END,
    CASE WHEN (CASE WHEN a.s <= b.s THEN b.s - a.e ELSE a.s - b.e END) < 0 THEN -b.n ELSE b.n END) AS r
  FROM {a} a JOIN {b} b USING (doc_id) WHERE (CASE WHEN a.s <= b.s THEN b.s - a.e ELSE a.s - b.e END) <= {gap})"""


@query(f"""WITH given AS (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '(?i){"|".join(WORDS.exclude)}')),
{_offsets("pr", WORDS.produce_words)}, {_offsets("rq", WORDS.requirement_words)}, {_offsets("op", WORDS.opening_words)}, {_offsets("ve", WORDS.venue_words)},
{_nearest("dm", "pr", "rq", WORDS.demand_gap)}, {_nearest("og", "op", "ve", WORDS.opening_gap)}
SELECT d.doc_id, coalesce(dm.gap, og.gap) IS NOT NULL AS ok, CASE WHEN dm.gap IS NOT NULL THEN 'demand' WHEN og.gap IS NOT NULL THEN 'opening' END AS rule,
  CASE WHEN dm.gap IS NOT NULL THEN 'requirement_candidate' WHEN og.gap IS NOT NULL THEN 'awareness' END AS tier, coalesce(dm.keywords, og.keywords, '') AS keywords, CAST(coalesce(dm.gap, og.gap) AS BIGINT) AS gap,
  CASE WHEN g.doc_id IS NULL THEN 'excluded operating model' END AS reason
FROM documents d LEFT JOIN given g USING (doc_id) LEFT JOIN dm ON dm.doc_id = d.doc_id AND dm.r = 1 LEFT JOIN og ON og.doc_id = d.doc_id AND og.r = 1""")
def matched_items(spark, d):
    """What every document says: the nearest pair of phrases that a rule asks for, with its distance in characters."""
    got = proximity.matched_items(read(spark, d, "documents"), "doc_id", "text", WORDS)
    return got.withColumn("keywords", F.array_join("keywords", "|"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#:]+(?::[0-9]+)?(/[^#]*)', 1)"
#: Patterns of the robots files; the twin tries every one on every path.
_RULES = """r AS (SELECT host, unnest(CASE WHEN len(host) % 3 = 0 THEN [{'p': '/en/', 'a': false}, {'p': '/en/*5', 'a': true}, {'p': '/', 'a': true}] ELSE
  [{'p': '/es', 'a': false}, {'p': '/es/*/', 'a': true}, {'p': '/*.html$', 'a': false}, {'p': '/fr/7', 'a': false}, {'p': '/fr/7*', 'a': true}, {'p': '/*?', 'a': false}, {'p': '/' || left(host, 2), 'a': true}] END) AS r FROM (SELECT DISTINCT host FROM u) WHERE len(host) % 5 <> 0)"""


@query(f"""WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, {_PATH} AS path FROM pages), {_RULES},
m AS (SELECT u.host, path, r.p, r.a FROM u JOIN r ON u.host = r.host AND regexp_matches(path, '^' || replace(replace(replace(regexp_replace(r.p, '\\$$', ''), '.', '\\.'), '?', '\\?'), '*', '.*') || CASE WHEN r.p LIKE '%$' THEN '$' ELSE '' END)),
b AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY len(p) DESC, a DESC) AS n FROM m)
SELECT host, path, coalesce(a, true) AS allowed FROM u LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (host, path)""")
def robots_hosts(spark, d):
    """Whether each path of the pages may be fetched, by a robots file for most hosts, written by the length of its name."""
    pages = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"), F.expr(_PATH.replace("'", '"')).alias("path"))
    own = F.lit("# own rules first\nUser-agent: LeadBot # us\nuser-agent: other\nDisallow: /en/\nAllow: /en/*5\nCrawl-delay: 3\nAllow: /\n\nUser-agent: *\nDisallow: /")
    of_all = F.concat(F.lit("Sitemap: /x\r\nUser-agent: other\r\nDisallow: /\r\nUser-agent: *\r\nDisallow: /es # all\r\nAllow: /es/*/\r\nno colon\r\nDisallow:\r\nDisallow: /*.html$\r\nDisallow: /fr/7\r\nAllow: /fr/7*\r\nDisallow: /*?\r\nAllow: /"), F.expr("left(host, 2)"))
    files = pages.select("host").distinct().where(F.length("host") % 5 != 0).select("host", F.when(F.length("host") % 3 == 0, own).otherwise(of_all).alias("body"))
    return robots.allowed_paths(pages, robots.robots_rules(files, "leadbot"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _deflated(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else [None if x is None else zlib.compress(x.encode("latin-1")) for x in p])


def printed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(path, content): every text as a PDF with an image first and 40 lines on a page; every second page is deflated. Null texts have no bytes.

    Words are strings of an array, with wide pushes between them; words beyond one byte a character are hexadecimal.
    Pages without such words are written by replacing within the whole page.
    """

    wide = "[^\\x00-\\xFF]"

    def word(w):
        return F.when(w.rlike(wide), F.concat(F.lit("<FEFF"), F.hex(F.encode(w, "UTF-16BE")), F.lit(">"))).otherwise(F.concat(F.lit("("), escaped(w), F.lit(")")))

    def escaped(x):
        for sign in "\\()":
            x = F.replace(x, F.lit(sign), F.lit(f"\\{sign}"))
        return x

    def pushed(x):
        return F.replace(escaped(x), F.lit(" "), F.lit(") -250.5 ("))

    def line(x):
        words = F.when(x.rlike(wide), F.array_join(F.transform(F.split(x, " "), word), " -250.5 ")).otherwise(F.concat(F.lit("("), pushed(x), F.lit(")")))
        return F.concat(F.lit("["), words, F.lit("] TJ T*\n"))

    def page(x):
        narrow = F.concat(F.lit("[("), F.replace(pushed(x), F.lit("\n"), F.lit(")] TJ T*\n[(")), F.lit(")] TJ T*\n"))
        shown = F.when(x.rlike(wide), F.array_join(F.transform(F.split(x, "\n"), line), "")).otherwise(narrow)
        return F.concat(F.lit("BT /F1 12 Tf 50 750 Td\n"), shown, F.lit("ET"))

    lines = F.split(text, "\n")
    sheets = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int")), lambda i: F.array_join(F.slice(lines, i * 40 + 1, F.lit(40)), "\n"))
    pages = F.transform(sheets, page)
    rows = rows.select(F.col(key).alias("path"), F.when(F.col(text).isNotNull(), pages).alias("pages"))
    rows = rows.withColumn("packed", _deflated(F.transform("pages", lambda p, i: F.when(i % 2 == 1, p))))
    plain = lambda p: F.concat(F.lit("8 0 obj << /Length 1 >>\nstream\n"), p, F.lit("\nendstream endobj\n"))
    deflated = lambda z: F.concat(F.lit("9 0 obj << /Filter /FlateDecode >> stream\r\n"), F.decode(z, "ISO-8859-1"), F.lit("\r\nendstream endobj\n"))
    numbered = F.transform(F.arrays_zip("pages", "packed"), lambda x, i: F.when(i % 2 == 0, plain(x["pages"])).otherwise(deflated(x["packed"])))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Subtype /Image /Filter /DCTDecode >> stream\n\xff\xd8(BT) Tj\nendstream endobj\n"), F.array_join(numbered, ""), F.lit("%%EOF"))
    return rows.select("path", F.encode(body, "ISO-8859-1").alias("content"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, (n - 1) // 40 AS page, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM l),
p AS (SELECT doc_id, page, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (line <> ''), '') AS t FROM c GROUP BY doc_id, page),
d AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS dense FROM p),
r AS (SELECT *, CASE WHEN dense = '' THEN 0 ELSE length(regexp_replace(dense, '[^A-Za-z0-9.,;:()/&%''"+@#*?!\\[\\]-]', '', 'g')) / length(dense) END AS ratio FROM d),
j AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (t <> '' AND ratio < 0.85) AS unreadable, coalesce(string_agg(t, chr(10) ORDER BY page) FILTER (ratio >= 0.85), '') AS text FROM r GROUP BY doc_id),
k AS (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) >= 40 AND len(regexp_extract_all(text, '\\b[A-Za-z]{3,}\\b')) >= 8 AS ok FROM j)
SELECT doc_id, coalesce(ok, false) AS ok, CASE WHEN k.doc_id IS NULL THEN 'not a pdf' WHEN NOT ok THEN 'unreadable' END AS reason, coalesce(pages + 1, 0) AS streams, coalesce(pages, 0) AS decoded, coalesce(unreadable, 0) AS unreadable, length(coalesce(k.text, '')) AS chars, CASE WHEN ok THEN md5(k.text) END AS text_md5
FROM documents LEFT JOIN k USING (doc_id)""")
def pdf_texts(spark, d):
    """The texts of the documents, printed as PDFs, read again stream by stream."""
    got = pdf.read_pdfs(printed(read(spark, d, "documents"), "doc_id", "text"), "path", "content", max_chars=None, blanks=quantity.SQL_BLANKS)
    return got.select(F.col("path").alias("doc_id"), "ok", "reason", "streams", "decoded", "unreadable", "chars", F.md5("text").alias("text_md5"))
