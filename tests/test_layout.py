"""Headings by their looks against plain loops; link bytes in each encoding."""

import base64
import hashlib
import random
from collections import Counter

from quire.sources import layout

RUN = "file string, page int, line int, ordinal int, text string, x0 double, top double, x1 double, bottom double, size double, font string"
BOX = "file string, page int, x0 double, top double, x1 double, bottom double"


def made(seed=3):
    r = random.Random(seed)
    runs, boxes = [], []
    for file in "abc":
        for page in range(3):
            for line in range(30):
                x, words = r.choice([40.0, 140.0, 150.0]), r.randint(1, 7)
                size, bold = r.choice([10.0, 10.0, 10.0, 12.0, 14.0, 11.96]), r.random() < 0.2
                for k in range(words):
                    text = (" " if k else "") + r.choice(["Scope", "of", "work.", "a", "Rules", "x" * 30, " "])
                    runs.append((file, page, line, k, text, x, line * 20.0, x + 6 * len(text), line * 20.0 + size, size + (0.04 if k else 0), "F-Bold" if bold and k else "F"))
                    x += 6 * len(text)
            boxes += [(file, page, 100.0, 100.0, 420.0, 260.0), (file, page, 0.0, 400.0, 143.9, 440.0), (file, page, 130.0, 280.0, 700.0, 300.0)]
    return runs, boxes


def by_loops(runs, boxes):
    out = []
    for file in "abc":
        sizes = Counter()
        for r in runs:
            if r[0] == file:
                sizes[round(r[9], 1)] += len("".join(r[4].split()))
        body = max(sizes.values())
        body = next(round(r[9], 1) for r in runs if r[0] == file and r[4].strip() and sizes[round(r[9], 1)] == body)
        for page in range(3):
            at = 0
            for line in range(30):
                own = [r for r in runs if r[:3] == (file, page, line)]
                text, start = "".join(r[4] for r in own), at
                at += len(text) + 1
                shown = [r for r in own if r[4].strip()]
                box = (min(r[5] for r in own), min(r[6] for r in own), max(r[7] for r in own), max(r[8] for r in own))
                if not shown or not 4 <= len(text.strip()) <= 150 or text.strip().endswith("."):
                    continue
                if any(b[:2] == (file, page) and box[0] >= b[2] and box[2] <= b[4] and box[1] >= b[3] and box[3] <= b[5] for b in boxes):
                    continue
                size = max(r[9] for r in shown)
                chars = [(c, r[10]) for r in own for c in r[4] if not c.isspace()]
                bold = sum("bold" in f.lower() for _, f in chars) / len(chars)
                if size >= body + 2 or bold >= 0.85:
                    out.append((file, page, line, start, text.strip(), 1 if size >= body + 4 else 2))
    return out


def test_heading_hints(spark):
    runs, boxes = made()
    found = layout.heading_hints(spark.createDataFrame(runs, RUN).repartition(3), spark.createDataFrame(boxes, BOX)).collect()
    want = by_loops(runs, boxes)
    assert sorted(tuple(r)[:6] for r in found) == sorted(want) and len(want) > 20


def test_boxes_and_lines_meet_in_squares(spark):
    runs, boxes = made(9)
    lines = layout.lines(spark.createDataFrame(runs, RUN))
    held = {(r.file, r.page, r.line) for r in layout.inside(lines, spark.createDataFrame(boxes, BOX)).collect()}
    every = lines.collect()
    assert held == {(r.file, r.page, r.line) for r in every for b in boxes if (r.file, r.page) == b[:2] and r.x0 >= b[2] and r.top >= b[3] and r.x1 <= b[4] and r.bottom <= b[5]}
    assert 0 < len(held) < len(every)
    assert "CartesianProduct" not in layout.inside(lines, spark.createDataFrame(boxes, BOX))._jdf.queryExecution().toString()


def test_body_size_ties(spark):
    rows = [("a", 0, 0, 0, "xx", 0.0, 0.0, 1.0, 1.0, 12.0, "F"), ("a", 0, 0, 1, "yy", 0.0, 0.0, 1.0, 1.0, 9.0, "F"), ("a", 0, 1, 0, "   ", 0.0, 0.0, 1.0, 1.0, 8.0, "F"), ("b", 0, 0, 0, " ", 0.0, 0.0, 1.0, 1.0, 8.0, "F")]
    assert [tuple(r) for r in layout.body_sizes(spark.createDataFrame(rows, RUN)).collect()] == [("a", 12.0)]


def test_link_bytes(spark):
    texts = {
        b"https://example.org/a": ("https://example.org/a", "utf-8"), "https://exämple.org/中".encode(): ("https://exämple.org/中", "utf-8"), "http://a.b/🙂".encode("utf-16"): ("http://a.b/🙂", "utf-16"),
        b"\xfe\xff" + "http://a.b/é🙂".encode("utf-16-be"): ("http://a.b/é🙂", "utf-16"), b"caf\xe9 \x84 \xa0 \x93": ("café — € ﬁ", "pdfdocencoding"), b"": ("", "utf-8"),
    }
    for bad in (b"\xfe\xff\xd8\x00", b"\xff\xfea", b"\xfe\xff\xdc\x00\x00a", b"\xff\xfe\x00\xd8a\x00"):
        texts[bad] = ("unresolved-uri:" + hashlib.sha256(bad).hexdigest(), "unresolved; original bytes preserved")
    rows = [(bytearray(k), None, [9.0, 8.0, 1.0, 2.0], 100.0) for k in texts] + [(None, "plain", [1.0], 100.0), (None, None, None, None)]
    got = layout.links(spark.createDataFrame(rows, "raw binary, uri string, rect array<double>, page_height double")).collect()
    assert {bytes(r.raw): (r.target, r.encoding) for r in got if r.raw is not None} == texts
    assert all(base64.b64decode(r.raw_base64) == bytes(r.raw) and r.bbox == [1.0, 92.0, 9.0, 98.0] for r in got if r.raw is not None)
    assert [(r.target, r.encoding, r.bbox) for r in got if r.raw is None] == [("plain", None, None)]


def test_page_tables(spark):
    rows = [("f", 1, 0, 0, 0, "a"), ("f", 1, 0, 0, 1, None), ("f", 1, 0, 1, 0, "c"), ("f", 1, 0, 1, 1, "d"), ("f", 1, 1, 0, 0, " "), ("f", 1, 1, 0, 1, None)]
    got = layout.page_tables(spark.createDataFrame(rows, "file string, page int, table int, row int, column int, text string")).collect()
    assert [(r.table, r.text, r.rows) for r in got] == [(0, "a | \nc | d", [["a", ""], ["c", "d"]])]
