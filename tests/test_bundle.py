"""A sound bundle has no problems; each kind of fault, planted alone, is found."""

import pytest
from pyspark.sql import functions as F

from quire.operators import bundle as bd
from quire.scratch import saved

SOUND = {
    "documents": ("version long, status string", [(1, "active"), (2, "review")]),
    "blocks": ("block long, version long, kind string, text string", [(10, 1, "text", "One rule. Two rules."), (20, 2, "table", "a | b")]),
    "links": ("version long, target string, location string", [(1, "https://x", "p1"), (1, "https://x", "p2")]),
    "sections": ("section long, version long, parent long, text string", [(100, 1, None, "One rule. Two rules."), (101, 1, 100, "Two rules."), (200, 2, None, "a | b")]),
    "spans": ("section long, block long, start int, end int, source_start int, source_end int", [(100, 10, 0, 20, 0, 20), (101, 10, 0, 10, 10, 20), (200, 20, 0, 9, 0, None)]),
    "chunks": ("chunk long, section long, version long, start int, end int, text string, locations array<string>", [(1000, 100, 1, 0, 9, "One rule.", ["p1"]), (1001, 101, 1, 0, 10, "Two rules.", ["p1"])]),
    "nodes": ("node long", [(1,), (2,), (100,)]),
    "edges": ("edge long, source long, target long, relation string, conditions array<string>, reviewer string, day string", [(5, 1, 100, "contains", None, None, None), (6, 100, 2, "overrides", ["c"], "r", "2024-05-01")]),
    "evidence": (
        "edge long, section long, version long, start int, end int, quote string, locations array<string>, link_target string",
        [(5, 100, 1, 0, 8, "One rule", ["p1", "p2"], "https://x"), (6, 101, 1, 4, 9, "rules", ["p1"], None), (6, 100, 1, 4, 8, "rule", ["p1"], None)],
    ),
}
#: A table, a condition on its rows, a column with its new value (or the rows once more), and the problems that this gives.
FAULTS = [
    ("documents", "version = 1", None, {("repeated version", "1")}),
    ("blocks", "block = 20", None, {("repeated block", "20")}),
    ("sections", "section = 101", None, {("repeated section", "101")}),
    ("chunks", "chunk = 1000", None, {("repeated chunk", "1000")}),
    ("nodes", "node = 2", None, {("repeated node", "2")}),
    ("edges", "edge = 5", None, {("repeated edge", "5")}),
    ("sections", "section = 200", ("version", "9L"), {("section without document", "200")}),
    ("sections", "section = 101", ("parent", "999L"), {("section without parent", "101")}),
    ("spans", "section = 200", ("block", "21L"), {("span without block", "200")}),
    ("spans", "section = 200", ("section", "section + 1"), {("span without section", "201")}),
    ("chunks", "chunk = 1001", ("section", "999L"), {("chunk without section", "1001")}),
    ("evidence", "start = 0", ("section", "999L"), {("evidence without section", "5")}),
    ("evidence", "start = 0", ("edge", "edge + 50"), {("evidence without edge", "55"), ("edge: no evidence", "5")}),
    ("edges", "edge = 5", ("source", "9L"), {("edge without source", "5")}),
    ("edges", "edge = 5", ("target", "9L"), {("edge without target", "5")}),
    ("spans", "section = 101", ("source_start", "9"), {("span is not its block's text", "101")}),
    ("spans", "section = 101", ("end", "11"), {("span is not its block's text", "101")}),
    ("chunks", "chunk = 1000", ("text", "'One rule'"), {("chunk is not its section's text", "1000")}),
    ("chunks", "chunk = 1000", ("text", "cast(null as string)"), {("chunk is not its section's text", "1000")}),
    ("chunks", "chunk = 1000", ("end", "99"), {("chunk is not its section's text", "1000")}),
    ("chunks", "chunk = 1000", ("start", "-1"), {("chunk is not its section's text", "1000")}),
    ("chunks", "chunk = 1000", ("version", "version + 1"), {("chunk is not its section's text", "1000")}),
    ("chunks", "chunk = 1000", ("locations", "cast(array() as array<string>)"), {("chunk is not its section's text", "1000")}),
    ("evidence", "start = 0", ("quote", "'Two rule'"), {("evidence is not its section's text", "5")}),
    ("evidence", "start = 0", ("quote", "' '"), {("evidence is not its section's text", "5"), ("edge: no evidence", "5")}),
    ("evidence", "start = 0", ("version", "version + 1"), {("evidence is not its section's text", "5"), ("link is not in its document", "5")}),
    ("evidence", "start = 0", ("link_target", "'https://y'"), {("link is not in its document", "5")}),
    ("links", "location = 'p2'", ("location", "'p3'"), {("link is not in its document", "5")}),
    ("edges", "edge = 6", ("reviewer", "' '"), {("edge: not reviewed", "6")}),
    ("edges", "edge = 6", ("conditions", "cast(null as array<string>)"), {("edge: not reviewed", "6")}),
    ("edges", "edge = 6", ("day", "'2024-02-30'"), {("edge: not a date", "6")}),
]


@pytest.fixture(scope="module")
def sound(spark):
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in SOUND.items()}


def test_sound(sound):
    assert bd.problems(sound).count() == 0
    empty = {name: t.where("false") for name, t in sound.items()}
    assert bd.problems(empty).count() == 0


IDS = {"version", "block", "section", "parent", "chunk", "node", "edge", "source", "target"}
STEP = 100_000


def test_faults(sound):
    """All faults at once, each in a copy of the sound bundle that has ids of its own."""
    bundle = {}
    for name, t in sound.items():
        parts = []
        for k, (table, where, change, _) in enumerate(FAULTS, start=1):
            own = t
            if table == name:
                own = t.unionByName(t.where(where)) if change is None else t.withColumn(change[0], F.when(F.expr(where), F.expr(change[1])).otherwise(F.col(f"`{change[0]}`")))
            parts.append((k, own))
        whole = None
        for k, own in parts:
            part = own.select(*((F.col(f"`{c}`") + k * STEP).alias(c) if c in IDS and kind == "bigint" else F.col(f"`{c}`") for c, kind in t.dtypes))
            whole = part if whole is None else whole.unionByName(part)
        bundle[name] = saved(whole)
    found = {}
    for r in bd.problems(bundle).distinct().collect():
        found.setdefault(int(r.key) // STEP, set()).add((r.problem, str(int(r.key) % STEP)))
    for k, (table, where, change, want) in enumerate(FAULTS, start=1):
        assert found.pop(k, set()) == want, (table, where, change)
    assert not found


def test_summary(sound):
    got = bd.summary(sound, sound["nodes"].where("node = 1")).first().asDict()
    assert got == {"documents": 2, "active_documents": 1, "archived_documents": 0, "documents_needing_review": 1, "graph_edges": 2, "overrides": 1, "tables": 1, "sections": 3, "chunks": 2, "graph_nodes": 3, "warnings": 1}
