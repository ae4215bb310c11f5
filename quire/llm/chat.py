"""Roles of transcript lines by a hidden Markov model, and canonical turns.

The states are a role with "first line of a turn" or "further line". A line is observed as one of 80 codes from its
speaker marker, its length and how it ends. Start, transition and emission weights are integer log probabilities from
smoothed counts over transcripts with known roles (a few hundred numbers, whatever the input's size).

All lines of all transcripts, in order, are one chain: a transcript's first line forgets what came before. Viterbi's
max-plus products of such lines are associative, so the chain is solved at three levels: stretches of PART lines, then
PART stretches at a time, then the rest; each level fixes the states at the ends of the level below. No task ever
holds a whole transcript, and integer weights make every grouping give the same path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import forget, saved

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line; 2 * role + 1: a further line
CODES = 5 * 4 * 4
PART, SCALE, NEVER = 1024, 1000, -(10**9)

#: Markers at the start of a line, by role; fixed formats of public chat transcripts.
MARKERS = {
    "system": r"(?i)^\s*(?:<\|system\|>|\[system\]|#{2,3} ?system:?|system:)\s*",
    "user": r"(?i)^\s*(?:<\|user\|>|\[inst\]|#{2,3} ?(?:human|user|instruction):?|(?:user|human|q):)\s*",
    "assistant": r"(?i)^\s*(?:<\|assistant\|>|\[/inst\]|#{2,3} ?(?:assistant|response):?|(?:assistant|bot|ai|a):)\s*",
}
OTHER = r"^\s*(?:>+|-{2,}|\w{1,12}:)\s"


def code(line: Column) -> Column:
    """The observation of a line: marker, length class and last character."""
    line = F.coalesce(line, F.lit(""))
    marker = F.when(line.rlike(MARKERS["system"]), 1).when(line.rlike(MARKERS["user"]), 2).when(line.rlike(MARKERS["assistant"]), 3).when(line.rlike(OTHER), 4).otherwise(0)
    n = F.length(line)
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 200, 2).otherwise(3)
    end = F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"[.!]\s*$"), 2).when(line.rlike(r"[:,;]\s*$"), 3).otherwise(0)
    return (marker * 16 + size * 4 + end).cast("int")


def fit(lines: DataFrame) -> dict[str, np.ndarray]:
    """Integer log probabilities from lines (conv_id, turn, line_no, line, role) with known roles; unknown roles are left out.

    Add-one smoothing; without lines all states are alike.
    """
    known = lines.where(F.col("role").isin(*ROLES))
    state = F.coalesce(*(F.when(F.col("role") == r, 2 * i) for i, r in enumerate(ROLES)))
    stated = known.select("conv_id", "turn", "line_no", (state + (F.col("line_no") > 0).cast("int")).alias("state"), code(F.col("line")).alias("code"))
    emit = np.ones((STATES, CODES))
    for s, c, n in stated.groupBy("state", "code").count().collect():  # STATES * CODES rows at most
        emit[s, c] += n
    ends = stated.groupBy("conv_id", "turn").agg(F.max("line_no").alias("last"), F.min("state").alias("role"))
    start, move = np.ones(STATES), np.ones((STATES, STATES))
    start[1::2] = 1e-6
    step = F.lead("role").over(Window.partitionBy("conv_id", F.expr("turn div 4096")).orderBy("turn"))  # long transcripts in pieces
    for role, after, lines_, turns, starts in ends.select("role", step.alias("after"), "last", (F.col("turn") == 0).cast("long").alias("first")).groupBy("role", "after").agg(F.sum("last"), F.count("*"), F.sum("first")).collect():
        s = role - role % 2
        move[s, s + 1] += min(lines_, turns)
        move[s + 1, s + 1] += max(0, lines_ - turns)
        start[s] += starts
        if after is not None:
            move[s, after - after % 2] += turns / 2
            move[s + 1, after - after % 2] += turns / 2
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                move[a, b] = 0  # a further line has the role of the line before
    with np.errstate(divide="ignore"):
        log = lambda x: np.where(x > 0, np.round(SCALE * np.log(np.where(x > 0, x, 1) / x.sum(-1, keepdims=True))), NEVER).astype(np.int64)
        return {"start": log(start), "move": log(move), "emit": log(emit)}


def matrices(codes: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The max-plus matrix of each line: from the state before to the state at the line."""
    m = np.where(first[:, None, None], w["start"][None, None, :], w["move"][None])
    return m + w["emit"].T[codes][:, None, :]


def product(m: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices in order."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[0 : len(m) - len(odd) : 2], m[1::2]
        m = np.concatenate(((a[:, :, :, None] + b[:, None, :, :]).max(2), odd))
    return m[0]


def solve(m: np.ndarray, before: int, end: int) -> np.ndarray:
    """The states after each matrix on the best path from state `before` (-1: any) to state `end` (-1: any); the least state on ties."""
    v = np.zeros(STATES, np.int64) if before < 0 else np.where(np.arange(STATES) == before, 0, NEVER * 1000)
    back = np.zeros((len(m), STATES), np.int64)
    for t in range(len(m)):
        s = v[:, None] + m[t]
        back[t] = s.argmax(0)
        v = s.max(0)
        v = v - v.max()
    out = np.zeros(len(m), np.int64)
    out[-1] = v.argmax() if end < 0 else end
    for t in range(len(m) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """lines with g, their number in the order of (conv_id, turn, line_no, line), and first, whether a transcript begins."""
    order = ["conv_id", "turn", "line_no"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_pylist()
            first = [a != b for a, b in zip([last if n else object(), *conv[:-1]], conv, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(conv), pa.int64()), pa.array(range(n, n + len(conv)), pa.int64()), pa.array(first)], names=[*batch.schema.names, "part", "within", "first"]
            )
            n, last = n + len(conv), conv[-1]

    schema = "conv_id long, turn long, line_no long, line string, code int, part long, within long, first boolean"
    made = saved(lines.repartitionByRange(*order).sortWithinPartitions(*order, "line").mapInArrow(count, schema))
    over = Window.orderBy("part")
    parts = made.groupBy("part").agg(F.count("*").alias("n"), F.max("conv_id").alias("last"))  # a row for each partition
    parts = parts.select("part", (F.sum("n").over(over) - F.col("n")).alias("base"), F.lag("last").over(over).alias("previous"), F.row_number().over(over).alias("k"))
    goes_on = (F.col("within") == 0) & (F.col("k") > 1) & F.col("conv_id").eqNullSafe(F.col("previous"))
    out = made.join(F.broadcast(parts), "part").withColumn("first", F.col("first") & ~goes_on).withColumn("g", F.col("base") + F.col("within"))
    return out.drop("part", "within", "base", "previous", "k")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of a sorted column."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        of = held.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def unpacked(column) -> np.ndarray:
    return np.array([np.frombuffer(x, np.int64) for x in column.to_pylist()]).reshape(-1, STATES, STATES)


def multiplied(rows: DataFrame, key: str, order: str, of) -> DataFrame:
    """(key, m): the product of the matrices of each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, key):
            yield pa.RecordBatch.from_arrays([pa.array([t.column(key)[0].as_py()], pa.int64()), pa.array([product(of(t)).tobytes()], pa.binary())], names=[key, "m"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} long, m binary")


def solved(rows: DataFrame, key: str, order: str, of) -> DataFrame:
    """rows with state, on the best path within each key from the state `before` to the state `end`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, key):
            state = solve(of(t), t.column("before")[0].as_py(), t.column("end")[0].as_py())
            yield from t.append_column("state", pa.array(state, pa.int32())).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{schema}, state int")


def recover(lines: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """conv_id, turn, line_no, role, begins and rendered for lines (conv_id, turn, line_no, line) in that order.

    role is the recovered one; begins, whether a turn begins; rendered, the line without its marker, with the canonical
    tags where one turn ends and another begins. turn and line_no only order the lines; of equal ones the order is
    that of the lines' text. Null lines are empty, null ids one transcript. No lines: no rows.
    """
    lines = lines.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("line_no").cast("long").alias("line_no"), "line", code(F.col("line")).alias("code"))
    rows = saved(numbered(lines).withColumn("part", F.expr(f"g div {PART}")))
    of_line = lambda t: matrices(t.column("code").to_numpy(), t.column("first").to_numpy(), weights)
    of_part = lambda t: unpacked(t.column("m"))
    thin = rows.select("g", "part", "code", "first")
    parts = saved(multiplied(thin, "part", "g", of_line).withColumn("many", F.expr(f"part div {PART}")))
    tops = multiplied(parts, "many", "part", of_part).withColumns({"all": F.lit(0).cast("long"), "before": F.lit(-1), "end": F.lit(-1)})
    ends = lambda t, key: t.select((F.col(key) + 1).alias(key), F.col("state").alias("before"))
    top = saved(solved(tops, "all", "many", of_part).select("many", "state"))  # one row for PART * PART lines
    bounded = lambda t, of, key: t.join(of.select(key, F.col("state").alias("end")), key).join(ends(of, key), key, "left").fillna(-1, ["before"])
    middle = saved(solved(bounded(parts, top, "many"), "many", "part", of_part).select("part", "state"))
    done = saved(solved(bounded(rows, middle, "part"), "part", "g", of_line))
    for t in (rows, parts):
        forget(t)
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.expr("state div 2 + 1").cast("int"))
    begins = F.col("first") | (F.col("state") % 2 == 0)
    plain = F.coalesce("line", F.lit(""))
    for marker in MARKERS.values():
        plain = F.regexp_replace(plain, marker, "")
    tag = F.when(begins, F.concat(F.when(F.col("first"), "").otherwise("<|end|>\n"), F.lit("<|"), role, F.lit("|>\n"))).otherwise("")
    return done.select("conv_id", "turn", "line_no", role.alias("role"), begins.alias("begins"), F.concat(tag, F.trim(plain)).alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of transcripts made from turns: in one of three styles, by conversation, with about a quarter of the markers left out."""
    digest_ = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary"))
    style = F.pmod("conv_id", F.lit(3))
    name = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    marker = F.when(digest_ % 4 == 0, "").when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": "))).otherwise(F.concat(F.lit("<|"), F.lower(name), F.lit("|> ")))
    text = F.concat(marker, F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def digest(conversations: DataFrame) -> DataFrame:
    """Every line of transcripts(), with its recovered role and its canonical form. Weights come from four of five conversations."""
    lines = transcripts(conversations)
    seen = lines.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0)
    return recover(lines, fit(seen))
