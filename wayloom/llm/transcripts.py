"""Transcript parsing: a hidden Markov model over line features recovers the speakers' roles by Viterbi, and turns are
rendered in one canonical form.

A transcript is a table of lines. Hidden states are a role and whether the line opens a turn or continues one. A line
shows a marker class (whom its beginning names, or how it is quoted) and how long and of what kind it is. Transition
and emission counts come from all lines with known roles, with smoothing; they are added up where the lines are, so a
few numbers reach the driver whatever the input.

Long transcripts are cut into blocks of lines: each block gives the best score from any state before it to any state at
its end, these small tables are put together for each transcript, and every block is then decoded between its known
ends. So no task holds a whole long transcript, and the result is that of Viterbi over all of it.

Null lines count as empty. Lines without a transcript id or line number are ignored. Equal line numbers are ordered by
text. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
#: States: a role's opening line, then its continuing line, role by role.
STATES = tuple(f"{r}:{k}" for r in ROLES for k in ("opens", "continues"))
#: Names that begin a turn in raw transcripts (fixed values).
NAMES = {
    "system": ("system", "context", "instructions", "setup"),
    "user": ("user", "human", "customer", "q", "question", "you", "me", "client"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "model"),
}
MARKER = re.compile(r"^\s*(?:[#>*\-\[(<|]+\s*)?(" + "|".join(sorted({n for v in NAMES.values() for n in v}, key=len, reverse=True)) + r")\s*(?:[\])>|*]+\s*:?|[:\-])\s*", re.IGNORECASE)
CLASS_OF = {n: i + 1 for i, r in enumerate(ROLES) for n in NAMES[r]}
N_MARKS, N_KINDS = len(ROLES) + 3, 12
#: Line numbers in a block, and the lines that one task decodes together, about.
BLOCK, PART_LINES = 4096, 50_000
#: Room for the lines of one turn in raw_lines' numbers, and the turns of a block of these.
TURN_ROOM, BLOCK_TURNS = 1 << 24, 64


def marker(line: str) -> tuple[int, str]:
    """The marker class of a line (0: none, 1 to 3: a role's name, 4: a quotation or dash, 5: an empty line) and the line without the marker."""
    if not line.strip():
        return len(ROLES) + 2, line
    m = MARKER.match(line)
    if m:
        return CLASS_OF[m[1].lower()], line[m.end() :]
    if line.lstrip()[:1] in (">", "-"):
        return len(ROLES) + 1, line.lstrip()[1:].lstrip()
    return 0, line


def kind(line: str) -> int:
    """A class by length and by how the line ends."""
    n = len(line.split())
    size = 0 if n <= 3 else 1 if n <= 12 else 2 if n <= 40 else 3
    end = line.rstrip()[-1:]
    return size * 3 + (1 if end == "?" else 2 if end in (".", "!", ":") else 0)


@dataclass
class Model:
    start: np.ndarray  # log scores of the first line's state
    step: np.ndarray  # of a state after another
    marks: np.ndarray  # of a marker class in a state
    kinds: np.ndarray  # of a line kind in a state

    def emission(self, mark: np.ndarray, kind_: np.ndarray) -> np.ndarray:
        return self.marks[:, mark].T + self.kinds[:, kind_].T


def possible() -> np.ndarray:
    """Which state may follow which: a turn continues with its own role only; an opening line ends the turn before."""
    ok = np.zeros((len(STATES), len(STATES)), dtype=bool)
    ok[:, 0::2] = True
    for r in range(len(ROLES)):
        ok[2 * r, 2 * r + 1] = ok[2 * r + 1, 2 * r + 1] = True
    return ok


def fit(starts: np.ndarray, steps: np.ndarray, marked: np.ndarray, kinded: np.ndarray) -> Model:
    """Smoothed relative counts, from the counts of first states, of steps, and of marker classes and kinds by state."""
    start, step, marks, kinds = starts + 0.5, steps + 0.5, marked + 0.2, kinded + 0.5
    start[1::2] = np.where(starts[1::2] > 0, start[1::2], 1e-9)
    step[~possible()] = 1e-9
    log = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(log(start), log(step), log(marks), log(kinds))


def through(model: Model, e: np.ndarray) -> np.ndarray:
    """Best scores over a block: from each state before it to each state at its last line."""
    best = model.step + e[0]
    for x in e[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + x
    return best


def between(model: Model, e: np.ndarray, before: np.ndarray, last: int | None = None) -> np.ndarray:
    """The best states of a block's lines. before: scores of the states of the line before; last: the state of the last line if known."""
    score, back = (before[:, None] + model.step).max(axis=0) + e[0], []
    for x in e[1:]:
        way = score[:, None] + model.step
        back.append(way.argmax(axis=0))
        score = way.max(axis=0) + x
    out = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def viterbi(model: Model, e: np.ndarray) -> np.ndarray:
    """The best states of a whole transcript, without blocks: the reference for tests and the way of short ones."""
    score, back = model.start + e[0], []
    for x in e[1:]:
        way = score[:, None] + model.step
        back.append(way.argmax(axis=0))
        score = way.max(axis=0) + x
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def observed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    got = [marker(x) for x in lines]
    return np.array([m for m, _ in got]), np.array([kind(t) for _, t in got]), [t for _, t in got]


def train(lines: DataFrame, role: str, opens: str, key: str = "conv_id", number: str = "line_no", text: str = "line", block: int = BLOCK) -> Model:
    """Counts from all lines whose role is known. Steps are counted block by block, and between the last line of a block and the first of the next."""
    code = F.when(F.col(role) == ROLES[0], 0)
    for i, r in enumerate(ROLES[1:], 1):
        code = code.when(F.col(role) == r, 2 * i)
    known = lines.filter(F.col(key).isNotNull() & F.col(number).isNotNull() & F.col(role).isin(*ROLES))
    own = known.select(F.col(key).alias("c"), F.col(number).cast("bigint").alias("n"), F.coalesce(text, F.lit("")).alias("t"), (code + F.when(F.coalesce(F.col(opens), F.lit(False)), 0).otherwise(1)).alias("s"))
    n = len(STATES)

    def emissions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((n, N_MARKS + N_KINDS), dtype=np.int64)
        for b in batches:
            m, k, _ = observed(b["t"].tolist())
            s = b["s"].to_numpy()
            if len(s):
                np.add.at(count, (s, m), 1)
                np.add.at(count, (s, N_MARKS + k), 1)
        a, b = np.nonzero(count)
        yield pd.DataFrame({"what": 2, "a": a, "b": b, "n": count[a, b]})

    shape = "what int, a int, b int, n bigint"
    seen = own.select("t", "s").mapInPandas(emissions, shape)
    rows = own.select("c", F.floor(F.col("n") / block).alias("b"), "n", F.xxhash64("t").alias("h"), "s")
    order = F.struct("n", "h")
    inside = rows.select("s", F.lag("s").over(Window.partitionBy("c", "b").orderBy("n", "h")).alias("was")).filter("was is not null")
    ends = rows.groupBy("c", "b").agg(F.min_by("s", order).alias("s"), F.max_by("s", order).alias("last"))
    between_ = ends.select("s", F.lag("last").over(Window.partitionBy("c").orderBy("b")).alias("was"))  # a row for each block
    steps = inside.unionByName(between_.filter("was is not null")).select(F.lit(1).alias("what"), F.col("was").alias("a"), F.col("s").alias("b"))
    first = between_.filter("was is null").select(F.lit(0).alias("what"), F.lit(0).alias("a"), F.col("s").alias("b"))
    counts = steps.unionByName(first).groupBy("what", "a", "b").agg(F.count("*").alias("n")).unionByName(seen).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    starts, step, emitted = np.zeros((1, n)), np.zeros((n, n)), np.zeros((n, N_MARKS + N_KINDS))
    for r in counts.collect():  # as many as there are states, steps and observations
        (starts, step, emitted)[r["what"]][r["a"], r["b"]] = r["n"]
    return fit(starts[0], step, emitted[:, :N_MARKS], emitted[:, N_MARKS:])


def decode(lines: DataFrame, model: Model, key: str = "conv_id", number: str = "line_no", text: str = "line", block: int = BLOCK) -> DataFrame:
    """(key, number, role, opens, said) of each line; said is the line without its marker."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    own = lines.filter(F.col(key).isNotNull() & F.col(number).isNotNull()).select(F.col(key).alias("c"), F.col(number).cast("bigint").alias("n"), F.coalesce(text, F.lit("")).alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, own.count() // PART_LINES, 1)
    own = own.withColumn("b", F.floor(F.col("n") / block)).withColumn("p", F.pmod(F.xxhash64("c", "b"), F.lit(parts)))
    kind_of = lines.schema[key].dataType.simpleString()
    long = own.groupBy("c").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo != hi").select("c")
    long, _ = written(long, "long")

    def blocks(rows: pd.DataFrame) -> Iterator[tuple]:
        rows = rows.sort_values(["c", "b", "n", "t"], kind="stable")
        for k, g in rows.groupby(["c", "b"], sort=False):
            mark, kinds, said = observed(g["t"].tolist())
            yield k, g, shared.value.emission(mark, kinds), said

    def tables(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = [(*k, through(shared.value, e).tobytes(), viterbi_end(shared.value, e).tobytes()) for k, _, e, _ in blocks(rows)]
        return pd.DataFrame(got, columns=["c", "b", "m", "f"])

    def ends(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The scores before each block and the state at its end: forwards over the tables, then backwards."""
        rows = rows.sort_values("b", kind="stable")
        n = len(STATES)
        m = [np.frombuffer(x).reshape(n, n) for x in rows["m"]]
        at = [np.frombuffer(rows["f"].iloc[0])]
        for x in m[1:]:
            at.append((at[-1][:, None] + x).max(axis=0))
        last = [int(at[-1].argmax())]
        for i in range(len(m) - 1, 0, -1):
            last.append(int((at[i - 1] + m[i][:, last[-1]]).argmax()))
        last = last[::-1]
        before = [np.full(n, -np.inf)] + [np.where(np.arange(n) == s, 0.0, -np.inf) for s in last[:-1]]
        return pd.DataFrame({"c": rows["c"], "b": rows["b"], "last": last, "before": [x.tobytes() for x in before]})

    def states(rows: pd.DataFrame, known: bool) -> pd.DataFrame:
        out = []
        for k, g, e, said in blocks(rows):
            if known and np.isfinite(before := np.frombuffer(g["before"].iloc[0])).any():
                s = between(shared.value, e, before, int(g["last"].iloc[0]))
            else:
                s = viterbi(shared.value, e) if not known else first_block(shared.value, e, int(g["last"].iloc[0]))
            out.append(pd.DataFrame({"c": g["c"], "n": g["n"], "role": [ROLES[x // 2] for x in s], "opens": s % 2 == 0, "said": said}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "n": [], "role": [], "opens": [], "said": []})

    schema = f"c {kind_of}, n bigint, role string, opens boolean, said string"
    short = own.join(long, "c", "left_anti").groupBy("p").applyInPandas(lambda rows: states(rows, False), schema)
    cut = own.join(long, "c", "left_semi")
    steps = cut.groupBy("p").applyInPandas(tables, f"c {kind_of}, b bigint, m binary, f binary")
    known = steps.groupBy("c").applyInPandas(ends, f"c {kind_of}, b bigint, last int, before binary")
    rest = cut.join(known, ["c", "b"]).groupBy("p").applyInPandas(lambda rows: states(rows, True), schema)
    return short.unionByName(rest).select(F.col("c").alias(key), F.col("n").alias(number), "role", "opens", "said")


def viterbi_end(model: Model, e: np.ndarray) -> np.ndarray:
    """Scores of the states at the last line of a transcript's first block."""
    score = model.start + e[0]
    for x in e[1:]:
        score = (score[:, None] + model.step).max(axis=0) + x
    return score


def first_block(model: Model, e: np.ndarray, last: int) -> np.ndarray:
    """The best states of a transcript's first block that end in `last`."""
    score, back = model.start + e[0], []
    for x in e[1:]:
        way = score[:, None] + model.step
        back.append(way.argmax(axis=0))
        score = way.max(axis=0) + x
    out = [last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def turns(decoded: DataFrame, key: str = "conv_id", number: str = "line_no", text: str = "said", block: int = BLOCK) -> DataFrame:
    """(key, turn_line, role, text): each turn in canonical form; turn_line is the number of its first line.

    A turn's number is its opening line's: found block by block, so long transcripts are not sorted in one task. Lines before the first
    opening one are a turn that begins with the transcript's first line; lines of one number belong to one turn."""
    b = F.floor(F.col(number) / block)
    rows = decoded.withColumn("b", b).withColumn("own", F.max(F.when(F.col("opens"), F.col(number))).over(Window.partitionBy(key, "b").orderBy(number)))
    closing = decoded.withColumn("b", b).groupBy(key, "b").agg(F.max(F.when(F.col("opens"), F.col(number))).alias("to"), F.min(number).alias("least"))
    carried = closing.select(key, "b", F.max("to").over(Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.min("least").over(Window.partitionBy(key)).alias("first"))
    rows = rows.join(carried, [key, "b"]).withColumn("turn_line", F.coalesce("own", "carried", "first"))
    grouped = rows.groupBy(key, "turn_line").agg(F.min_by("role", number).alias("role"), F.sort_array(F.collect_list(F.struct(F.col(number), F.col(text).alias("t")))).alias("ls"))
    return grouped.select(key, "turn_line", "role", F.trim(F.array_join("ls.t", "\n")).alias("text"))


def rendered(role: str = "role", text: str = "text") -> Column:
    """A turn in the canonical form of a chat transcript."""
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), F.col(text), F.lit("\n<|end|>"))


def raw_lines(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Raw transcript lines of a table of turns (conv_id, turn, role, text), in a marker style by transcript; some turns have none.

    Adds line_no (turn * TURN_ROOM + line), and the true role and opens for learning and tests."""
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "Bot").when(F.col("role") == "system", "Context").otherwise("")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    role = F.coalesce("role", F.lit(""))
    name = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("["), role, F.lit("] "))).when(style == 2, F.concat(F.lit("**"), F.initcap(role), F.lit(":** "))).when(style == 3, F.concat(other, F.lit(": "))).otherwise(F.concat(F.lit("> "), other, F.lit(": ")))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    raw = F.when(bare, F.col("text")).otherwise(F.concat(name, F.col("text")))
    lines = rows.select("conv_id", "turn", "role", F.posexplode(F.split(raw, "\n", -1)).alias("i", "line"))
    return lines.select("conv_id", (F.col("turn") * TURN_ROOM + F.col("i")).alias("line_no"), "line", "role", (F.col("i") == 0).alias("opens"))
