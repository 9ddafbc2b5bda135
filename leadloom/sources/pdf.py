"""Text of PDF documents: every stream of a file is a row, inflated and read by itself, and the texts are joined in order.

Files are scanned as characters, one for each byte. What a stream paints is read by column expressions; only inflating
needs Python. A stream is one row and a file's text is one row; files of any number spread over the tasks.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantity
from ..names import free_names

# Fixed values of the format, and the limits that a readable text must meet.
#: A push of so many thousandths of an em inside a text array is a blank.
BLANK_PUSH = -120
SHOWING = ("Tj", "TJ", "'", '"')
ENDING_LINES = ("Td", "TD", "T*", "ET", "BT", "'", '"')
IMAGES = r"/Subtype\s*/Image\b|/(?:DCT|JPX|CCITTFax|JBIG2)Decode\b"
UNSUPPORTED = r"/(?:LZW|RunLength|ASCII85|ASCIIHex)Decode\b|/Crypt\b"
READABLE_RATIO = 0.85
MAX_CHARS = 20_000

#: Brackets within a string may nest so deep; possessive, so no text is too long for the matcher's stack.
_NESTED = 6


def _string_pattern() -> str:
    inner = r"\((?:[^\\()]++|\\.)*+\)"
    for _ in range(_NESTED):
        inner = rf"\((?:[^\\()]++|\\.|{inner})*+\)"
    return inner


_SHOWN = rf"(?:{_string_pattern()}|<(?!<)[^>]*+>)"
#: Operands, then the operator they belong to; at the end of a stream there may be none. The first class holds what is
#: common, as Java tests it six times as fast as the second.
_STEP = rf"(?s)((?:[\[\] .0-9\n-]++|[^A-Za-z'\"*(<]|{_SHOWN}|<)*+)([A-Za-z'\"*][A-Za-z0-9*'\"]*+|\z)"
#: The operator that ends a step, told by what stands before it: strings end in brackets, other operands have none of its signs.
_OPERATOR = r"(?<![A-Za-z'\"*])[A-Za-z'\"*][A-Za-z0-9*'\"]*+\z"
_ARRAY = rf"(?s)\[(?:[^\]\[(<]++|{_SHOWN}|<)*+\]|{_SHOWN}"
#: A string and what stands between it and the next.
_UNIT = rf"(?s)({_SHOWN})([^(<]*+)"
#: An array whose strings have neither escapes, marks nor brackets, and whose numbers are short, is read by replacing what stands between them.
_PLAIN_ARRAY = r"(?s)\A\[[^\\<()þ]*+(?:\([^\\<()þ]*+\)\s*+(?:-?\d{1,6}(?:\.\d{1,6})?)?\s*+)++\]\z"
#: A push of BLANK_PUSH or wider between two strings.
_WIDE_GAP = r"\)\s*+-0*+(?:1[2-9]\d|[2-9]\d\d|[1-9]\d{3,})(?:\.\d++)?\s*+\("
#: A stream whose strings all stand in arrays before TJ and have neither escapes, marks nor brackets, whose numbers in arrays
#: are short, and whose other operands are neither strings nor digits right before letters: it is read by replacing, too.
_FILL = r"\s*+(?:-?\d{1,6}(?:\.\d{1,6})?+(?![.\d]))?+\s*+"
_OTHER = r"(?:[^A-Za-z0-9*\\<()'\"\[\]]++|[A-Za-z*][A-Za-z0-9*]*+|[0-9]++(?![A-Za-z*]))*+"
_PLAIN_STREAM = rf"(?s)\A{_OTHER}(?:\[{_FILL}(?:\((?!þÿ)[^\\()]*+\){_FILL})*+\]\s*+TJ(?![A-Za-z0-9*'\"]){_OTHER})*+\z"
#: Between two strings of a plain stream, an operator that ends the line.
_LINE_GAP = r"\)[^()]*?(?<![A-Za-z0-9*])(?:T[dD*]|ET|BT)(?![A-Za-z0-9*])[^()]*+\("
#: White space other than blanks and line feeds, and what Java's patterns take for the end of a line.
_ODD_BLANKS = r"[\t\x0B\f\r\x85\u2028\u2029]"
_STREAM = r"(?s)<<.{0,8000}?>>\s*stream(?:\r\n|\r|\n).*?endstream"
_HEAD = r"(?s)^<<.{0,8000}?>>\s*stream(?:\r\n|\r|\n)"


@F.pandas_udf(T.BinaryType())
def inflate(packed: pd.Series) -> pd.Series:
    """The inflated bytes, with or without a zlib header; null where they are neither or end early. What follows their end is not read."""

    def one(data: bytes | None) -> bytes | None:
        for window in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            reader = zlib.decompressobj(window)
            try:
                out = reader.decompress(data) if data is not None else None
            except zlib.error:
                continue
            if reader.eof:
                return out
        return None

    return packed.map(one)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def _bytes_as_text(c: Column) -> Column:
    return F.decode(c, "ISO-8859-1")


def _utf16(hexed: Column) -> Column:
    """Text of UTF-16BE code units in hexadecimal; half pairs become U+FFFD, an odd byte at the end goes."""
    units = _all(hexed, "(?i)D[89AB]..D[C-F]..|....")
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.when((F.length(u) == 4) & u.rlike("(?i)^D[89A-F]"), "FFFD").otherwise(u)), "")), "UTF-16BE")


def _string(token: Column) -> Column:
    """What a literal or hexadecimal string stands for; most have neither escapes nor marks and are cut out as they are."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)

    def unescaped(u: Column) -> Column:
        rest = F.substring(u, F.lit(2), F.length(u) - 1)
        control = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": "", "\r\n": ""}
        out = F.when(~u.startswith("\\"), u).when(rest.rlike("^[0-7]"), F.chr(F.conv(rest, 8, 10).cast("long") % 256))
        for name, char in control.items():
            out = out.when(rest == name, F.lit(char))
        return out.otherwise(rest)

    literal = F.array_join(F.transform(_all(inner, r"(?s)\\[0-7]{1,3}|\\\r\n|\\.|[^\\]++"), unescaped), "")
    digits = F.upper(F.regexp_replace(inner, "[^0-9A-Fa-f]", ""))
    even = F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))
    wide = lambda hexed: _utf16(F.substring(hexed, F.lit(5), F.length(hexed)))
    escaped = F.contains(token, F.lit("\\"))
    return (
        F.when(token.startswith("<"), F.when(digits.startswith("FEFF"), wide(even)).otherwise(_bytes_as_text(F.unhex(even))))
        .when(token.rlike(r"^\((?:þ|\\376)(?:ÿ|\\377)"), wide(F.hex(F.encode(literal, "ISO-8859-1"))))
        .when(escaped, literal)
        .otherwise(inner)
    )


def _shown(operands: Column) -> Column:
    """The strings of an operator; within an array, a wide push after a string is a blank."""

    def of_array(token: Column) -> Column:
        def unit(text: Column, gap: Column) -> Column:
            pushed = F.exists(_all(gap, "[-.0-9]++"), lambda n: F.coalesce(n.try_cast("double") <= BLANK_PUSH, F.lit(False)))
            return F.concat(_string(text), F.when(pushed, " ").otherwise(""))

        return F.array_join(F.zip_with(_all(token, _UNIT, 1), _all(token, _UNIT, 2), unit), "")

    def of_plain_array(token: Column) -> Column:
        strings = F.regexp_replace(F.regexp_replace(token, _WIDE_GAP, " "), r"\)[^()]*+\(", "")
        return F.regexp_replace(strings, r"^[^(]*+\(|\)[^)]*+\z", "")

    def of_operand(token: Column) -> Column:
        return F.when(token.rlike(_PLAIN_ARRAY), of_plain_array(token)).when(token.startswith("["), of_array(token)).otherwise(_string(token))

    return F.array_join(F.transform(_all(operands, _ARRAY), of_operand), "")


def _named(c: Column, of) -> Column:
    """`of` of a column that is worked out once, however often `of` has it."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def _painted(content: Column) -> Column:
    """What the steps of a stream show, with line feeds where lines end."""

    def step(token: Column, operator: Column) -> Column:
        shown = F.when(operator.isin(*SHOWING, ""), _shown(token)).otherwise("")
        return F.concat(shown, F.when(operator.isin(*ENDING_LINES), "\n").otherwise(""))

    return _named(_all(content, _STEP), lambda t: F.array_join(F.zip_with(t, F.transform(t, lambda x: F.regexp_extract(x, _OPERATOR, 0)), step), ""))


def _painted_plain(content: Column) -> Column:
    """The same of a plain stream, but for line feeds before the first string and after the last."""
    lines = F.regexp_replace(F.regexp_replace(content, _WIDE_GAP, " "), _LINE_GAP, "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\)[^()]*+\(", ""), r"\A[^(]*+(?:\(|\z)|\)[^)]*+\z", "")


def _tidy(painted: Column) -> Column:
    """Blanks are drawn together, lines trimmed, empty lines left out; most texts have only blanks and line feeds for white space."""
    lines = F.transform(F.split(painted, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), r"^\s+|\s+$", ""))
    plain = F.btrim(F.regexp_replace(F.regexp_replace(painted, " *+\n[ \n]*+", "\n"), "  ++", " "), F.lit(" \n"))
    return F.when(painted.rlike(_ODD_BLANKS), F.array_join(F.filter(lines, lambda x: x != ""), "\n")).otherwise(plain)


def content_text(content: Column) -> Column:
    """What a decoded content stream paints, in painting order: blanks are drawn together, empty lines go.

    A line break within a string ends a line too. A string whose brackets are never closed, or nest deeper than seven, is
    passed over up to the next bracket. Null stays null.
    """
    return _named(F.when(content.rlike(_PLAIN_STREAM), _painted_plain(content)).otherwise(_painted(content)), _tidy)


def pdf_streams(files: DataFrame, key: str = "path", data: str = "content") -> DataFrame:
    """(key, digest, is_pdf, at, reason, content) with a row for each stream of each file, in the file's order from 0.

    `content` is the decoded stream, a character for each byte, or null with the reason. A file without streams, or
    that is no PDF, has one row whose `at` is null. `digest` tells files apart that bear one key.
    """
    chars = _bytes_as_text(F.col(data))
    is_pdf = F.coalesce(F.contains(F.substring(chars, 1, 1024), F.lit("%PDF-")), F.lit(False))
    rows = files.select(F.col(key).alias("key"), F.sha2(F.col(data), 256).alias("digest"), is_pdf.alias("is_pdf"), F.when(is_pdf, chars).alias("chars"))
    rows = rows.select("key", "digest", "is_pdf", F.posexplode_outer(_all(F.col("chars"), _STREAM)).alias("at", "stream"))
    head = F.regexp_extract("stream", _HEAD, 0)
    body = F.substring("stream", F.length("head") + 1, F.length("stream") - F.length("head") - len("endstream"))
    rows = rows.withColumn("head", head).withColumn("body", body)
    image, flate = F.col("head").rlike(IMAGES), F.col("head").rlike(r"/FlateDecode\b")
    rows = rows.withColumn("kind", F.when(image, "image stream").when(flate, "flate").when(F.col("head").rlike(UNSUPPORTED), "unsupported filter"))
    packed = F.when(F.col("kind") == "flate", F.encode("body", "ISO-8859-1"))
    rows = rows.withColumn("inflated", inflate(packed))
    # the line end before the closing word is none of the data, but inflated bytes know their own end, which may be such a sign
    tail = F.when(F.col("body").endswith("\r\n"), 2).when(F.col("body").endswith("\n") | F.col("body").endswith("\r"), 1).otherwise(0)
    bare = F.substring("body", F.lit(1), F.length("body") - tail)
    content = F.when(F.col("kind").isNull(), bare).when(F.col("kind") == "flate", _bytes_as_text(F.col("inflated")))
    reason = F.when((F.col("kind") == "flate") & F.col("inflated").isNull(), "inflating failed").when(F.col("kind") != "flate", F.col("kind"))
    return rows.select("key", "digest", "is_pdf", "at", reason.alias("reason"), content.alias("content"))


def read_pdfs(files: DataFrame, key: str = "path", data: str = "content", max_chars: int | None = MAX_CHARS, blanks: str = quantity.BLANKS) -> DataFrame:
    """The text of every file: (`key`, ok, text, reason, detail, streams, decoded, unreadable, chars, truncated).

    `files` is what `spark.read.format("binaryFile")` gives, or any table with a key and bytes; other columns are not
    read. Rows equal in key and bytes are one file; files of one key that differ are a row each; a null key is a key.
    Null or empty bytes and other formats are "not a pdf". A stream that paints no words is left out, the rest is kept;
    text beyond `max_chars` is cut and said to be truncated, and None keeps all. `blanks` are not counted where it is
    told whether a text is readable. An empty table gives no rows.
    """
    paints = F.col("content").rlike(r"\b(?:Tj|TJ|BT)\b")
    rows = pdf_streams(files, key, data).withColumn("text", F.when(paints, content_text(F.col("content"))))
    rows = rows.withColumn("text", F.when(F.col("text") != "", F.col("text")))
    rows = rows.withColumn("worded", quantity.readable_ratio(F.col("text"), blanks) >= READABLE_RATIO)  # a column, so it is worked out once
    worded = F.col("worded")
    stream = F.struct("at", F.col("content").isNotNull().alias("decoded"), (F.col("text").isNotNull() & ~worded).alias("noise"), F.when(worded, F.col("text")).alias("text"), "reason")
    rows = rows.select("key", "digest", "is_pdf", F.when(F.col("at").isNotNull(), stream).alias("stream"))  # what is folded has no content
    folded = rows.groupBy("key", "digest", "is_pdf").agg(F.array_sort(F.collect_set("stream")).alias("s"))
    texts = F.filter(F.transform("s", lambda x: x["text"]), lambda x: x.isNotNull())
    count = lambda field: F.size(F.filter("s", lambda x: x[field]))
    out = folded.select("key", "is_pdf", F.size("s").alias("streams"), count("decoded").alias("decoded"), count("noise").alias("unreadable"), F.array_join(texts, "\n").alias("joined"), F.array_sort(F.array_distinct(F.filter(F.transform("s", lambda x: x["reason"]), lambda x: x.isNotNull()))).alias("reasons"))
    out = out.withColumn("ok", F.col("is_pdf") & quantity.is_readable(F.col("joined"), READABLE_RATIO, blanks=blanks))
    ok = F.col("ok")
    detail = (
        F.when(~F.col("is_pdf") | ok, F.lit(None))
        .when(F.col("streams") == 0, "no streams")
        .when(F.col("decoded") == 0, F.concat(F.lit("no stream decoded: "), F.array_join("reasons", ", ")))
        .when((F.col("joined") == "") & (F.col("unreadable") == 0), "no text operators")
        .otherwise("no words")
    )
    text = F.col("joined") if max_chars is None else F.substring("joined", 1, max_chars)
    chars = F.length("joined")
    (name,) = free_names(["ok", "text", "reason", "detail", "streams", "decoded", "unreadable", "chars", "truncated"], key)
    return out.select(
        F.col("key").alias(name), "ok", F.when(ok, text).alias("text"),
        F.when(~F.col("is_pdf"), "not a pdf").when(~ok, "unreadable").alias("reason"), detail.alias("detail"),
        "streams", "decoded", "unreadable", chars.alias("chars"), (ok & (F.lit(False) if max_chars is None else chars > max_chars)).alias("truncated"),
    )
