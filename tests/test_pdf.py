"""PDF files read stream by stream: strings, arrays, filters, reasons, awkward rows."""

import random
import zlib

from pyspark.sql import functions as F

from leadloom.sources import pdf

NOTICE = b"BT /F1 12 Tf (Notice inviting tenders for) Tj T* [(Supply of veg) -300 (etables to the hostel mess)] TJ ET"
TEXT = "Notice inviting tenders for\nSupply of veg etables to the hostel mess"


def stream(content, head=b"/Length 5"):
    return b"1 0 obj << " + head + b" >> stream\n" + content + b"\nendstream endobj\n"


def flate(content, packed=None):
    return stream(packed or zlib.compress(content), b"/Filter /FlateDecode")


def painted(spark, *contents):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string")
    return [r["t"] for r in rows.select("i", pdf.content_text(F.col("c")).alias("t")).orderBy("i").collect()]


def test_strings(spark):
    cases = {
        r"(a\(b\)\\c) Tj": "a(b)\\c",
        r"(one (two (three)) four) Tj": "one (two (three)) four",
        "(\\101\\1022\\7) Tj": "AB2\x07",
        "(a\\\nb\\\r\nc\\qd) Tj": "abcqd",
        "<48 65 6C6c 6F> Tj": "Hello",
        "<414> Tj": "A@",
        "<FEFF0BB8D83DDE00D83D0041> Tj": "ஸ\U0001f600�A",
        "(þÿ\\000A\\000\\102) Tj": "AB",
        "[(ve) -20 (g) -120 (s) -119.9 (t ) -500 (u)] TJ": "veg st u",
        "(a) Tj [-300 (b)] TJ -300 (c) Tj": "abc",
        "(kept) /F1 Tf (shown) Tj": "shown",
        "(a) ' (b) Tj 0 -10 Td (c) Tj": "a\nb\nc",
        "(  a \\t b ) Tj T* ( ) Tj ET (at the end)": "a b\nat the end",
        "(never closed Tj (x) Tj": "x",
        "": "",
        "[] TJ () Tj <> Tj": "",
    }
    assert painted(spark, *cases) == list(cases.values())


def test_plain_streams_read_as_others_do(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["", "a", "two words", " b ", "(c)", "(", "it's", "T*", "x<y", "[z]", "\n", "\t", "-300", "þÿ", "þ", "\\\\", "c\u0085", "  "])
    gap = lambda: rng.choice(["", " ", "-300", " -250.5 ", "-119", "-120", " 12 ", "-0120.00", "-1234567", "--3", "-120.1234567", "- 300", "-300 -300", "\n-120\n"])
    other = lambda: rng.choice(["", " ", " T* ", "\nTd\n", " 0 -10 Td ", " 0 -10Td", " /F1 12 Tf ", " /T* ", "ET", " ET BT ", " q ", " aTd ", " 1 0 0 1 5 5 Tm ", " a12Td ", " (x) Tj ", " <41> Tj ", " ' ", " Tj ", " TJ ", " [", "]"])
    array = lambda: gap() + "".join("(" + word() + ")" + gap() for _ in range(rng.randrange(4)))
    streams = [other() + "".join("[" + array() + "]" + rng.choice([" ", ""]) + rng.choice(["TJ", "TJ", "TJ", "TJx", "Tj"]) + other() + other() for _ in range(rng.randrange(5))) for _ in range(4000)]
    streams += ["", " ", "BT ET", "[] TJ", "[(only)] TJ", "[(a)] TJ [(b)] TJ", "[(a)] TJ q [(b) -300 (c)] TJ T* [(d)] TJ ET"]
    c = F.col("c")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(streams)], "i int, c string")
    got = rows.select("c", c.rlike(pdf._PLAIN_STREAM).alias("plain"), pdf.content_text(c).alias("text"), pdf._named(pdf._painted(c), pdf._tidy).alias("stepped")).collect()
    assert sum(r["plain"] for r in got) > 500 and sum(not r["plain"] for r in got) > 500
    assert [(r["c"], r["text"]) for r in got] == [(r["c"], r["stepped"]) for r in got]
    assert got[-1]["plain"] and got[-1]["text"] == "ab c\nd"


def test_each_text_is_worked_out_once(spark):
    files = spark.createDataFrame([("a", b"%PDF-1.4\n" + flate(NOTICE))], "path string, content binary")
    plan = pdf.read_pdfs(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pdf._STEP) == 1 and plan.count("A-Za-z0-9.,;:()/&%") == 2  # the last of a stream and of a file


def test_long_content_needs_no_stack(spark):
    words = [f"w{i}" for i in range(60_000)]
    array = "[" + " -300 ".join(f"({w})" for w in words) + "] TJ"
    long_string = "(" + "x\\)" * 200_000 + ") Tj"
    hexed = "<" + "41" * 300_000 + "> Tj"
    got = painted(spark, array, long_string, hexed, None)
    assert got[0] == " ".join(words) and got[1] == "x)" * 200_000 and got[2] == "A" * 300_000 and got[3] is None


def test_files(spark):
    noise = b"BT (" + bytes(range(128, 255)) + b") Tj ET"
    raw = zlib.compressobj(wbits=-15)
    files = {
        "plain": b"%PDF-1.4\n" + stream(NOTICE),
        "packed": b"junk\n%PDF-1.4\n" + flate(NOTICE),
        "raw": b"%PDF-1.4\n" + flate(None, raw.compress(NOTICE) + raw.flush()),
        "mixed": b"%PDF-1.4\n<< /Type /Catalog >> endobj " + stream(b"\xff\xd8", b"/Subtype /Image") + stream(noise) + flate(NOTICE) + flate(None, b"broken") + stream(b"q Q"),
        "picture": b"%PDF-1.4\n" + stream(b"\xff\xd8", b"/Filter /DCTDecode") + stream(b"~>", b"/Filter /LZWDecode"),
        "drawn": b"%PDF-1.4\n" + stream(b"0 0 m 1 1 l S"),
        "fonts": b"%PDF-1.4\n" + stream(noise),
        "short": b"%PDF-1.4\n" + stream(b"BT (two words) Tj ET"),
        "bare": b"%PDF-1.4\n%%EOF",
        "cut": b"%PDF-1.4\n<< >> stream\nBT (x) Tj",
        "empty": b"",
        "late": b" " * 1024 + b"%PDF-1.4\n" + stream(NOTICE),
    }
    rows = spark.createDataFrame([*files.items(), ("null", None), (None, files["plain"])], "text string, content binary")
    got = {r[0]: r for r in pdf.read_pdfs(rows.withColumn("digest", F.lit(1)), "text").collect()}
    assert len(got) == len(files) + 2
    assert {k: (r["ok"], r["reason"], r["detail"], r["streams"], r["decoded"], r["unreadable"]) for k, r in got.items()} == {
        "plain": (True, None, None, 1, 1, 0), "packed": (True, None, None, 1, 1, 0), "raw": (True, None, None, 1, 1, 0), "mixed": (True, None, None, 5, 3, 1), None: (True, None, None, 1, 1, 0),
        "picture": (False, "unreadable", "no stream decoded: image stream, unsupported filter", 2, 0, 0), "drawn": (False, "unreadable", "no text operators", 1, 1, 0),
        "fonts": (False, "unreadable", "no words", 1, 1, 1), "short": (False, "unreadable", "no words", 1, 1, 0), "bare": (False, "unreadable", "no streams", 0, 0, 0), "cut": (False, "unreadable", "no streams", 0, 0, 0),
        "empty": (False, "not a pdf", None, 0, 0, 0), "null": (False, "not a pdf", None, 0, 0, 0), "late": (False, "not a pdf", None, 0, 0, 0),
    }
    assert all(r["text"] == TEXT for r in got.values() if r["ok"]) and all(r["text"] is None for r in got.values() if not r["ok"])


def test_order_repeats_and_cuts(spark):
    page = lambda i: b"BT (page %d of the notice holds some plain words here) Tj ET" % i
    data = b"%PDF-1.4\n" + b"".join((flate if i % 3 else stream)(page(i)) for i in range(25))
    other = b"%PDF-1.4\n" + stream(NOTICE)
    rows = spark.createDataFrame([("a", data), ("a", data), ("a", other), ("b", data)], "path string, content binary")
    got = pdf.read_pdfs(rows.repartition(3), max_chars=60).collect()
    whole = "\n".join(page(i).decode()[4:-7] for i in range(25))
    assert sorted((r["path"], r["streams"], r["text"], r["chars"], r["truncated"]) for r in got) == [("a", 1, TEXT[:60], len(TEXT), True), ("a", 25, whole[:60], len(whole), True), ("b", 25, whole[:60], len(whole), True)]
    assert {r["text"] for r in pdf.read_pdfs(rows, max_chars=None).collect()} == {whole, TEXT}
    assert pdf.read_pdfs(rows.limit(0)).collect() == []


def test_files_on_disk(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.pdf").write_bytes(b"%PDF-1.4\n" + flate(NOTICE))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r["path"][-5:], r["text"]) for r in pdf.read_pdfs(files).orderBy("path").collect()] == [(f"{i}.pdf", TEXT) for i in range(4)]
