"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation's rows, in order of their turns (nulls first), are kept, given another role,
deleted, or preceded by inserted rows with empty texts, until the initials of the roles read
``(s?(ua)+)?``. Of the cheapest edits those whose initials (D, I, K, R) come first in ASCII
order are taken. They are found by iterative-deepening A*: a depth-first search in ASCII
order under a bound on cost that rises to the least cost it was exceeded by, with a table of
states that failed within some rest of the bound. So the first path that it accepts is the answer.

A conversation of at most ``BLOCK`` rows is one search. A longer one is cut into blocks of so
many rows; a search for each (entry, exit) role of a block gives that block's cheapest edits,
and the blocks are joined by keeping the best way to each role. This is exact: a block's edits
end with one that takes a row, so none is the beginning of another, and the first block in
which two ways differ decides which one comes first.

Rows travel once, by conversation, sorted, and are read as a stream: a task holds one block of
texts, the audit so far and four running digests, however long a conversation is. Rows that
repeat an earlier one are found before, by digests of role and text, so no set of what was
seen is held.

Results: null roles and texts count as one blank; a null conversation is one as any other, and
a null id or turn is one blank where rows are damaged. Rows with equal turns are ordered by
role, then by the digest of role and text; rows that are wholly equal are duplicates of the
first. A role with another initial than s, u, a (or none) can't be kept. A conversation
without rows after damage has zeros, an empty audit and the digest of nothing. Extra columns
are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citeweave.llm.common import sliced

BLOCK = 16
#: Characters that count as white space, and those that end a text (fixed values).
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 1, 2, 5, 5
#: What the rows so far end with: nothing, a system, user or assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The role that must follow a state, and the state it leads to; a system row may follow only nothing.
FOLLOWS = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: What has to be inserted at the end, by state.
CLOSING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
CLEAN, CUT, GONE = "ktx"


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of that initial is kept, or None."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return FOLLOWS[state][1] if FOLLOWS[state][0][0] == initial else None


def _bounds(rows: str) -> tuple[list[int], list[int]]:
    """(least, systems) of each suffix: the least cost of its rows, and its clean system rows.

    A row that must go costs a deletion at least, one cut short too, one of no known role a
    change. Of a run of equal neighbours every second one must change. A clean system row costs
    nothing only as the first row that stays.
    """
    n = len(rows) // 2
    least, systems, run = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault = rows[2 * i], rows[2 * i + 1]
        systems[i] = systems[i + 1]
        if fault != CLEAN:
            least[i] = least[i + 1] + DELETE
        elif initial == "s":
            systems[i] += 1
            least[i] = least[i + 1]
        elif initial not in "ua":
            least[i] = least[i + 1] + REROLE
        else:
            same = i + 1 < n and rows[2 * i : 2 * i + 2] == rows[2 * i + 2 : 2 * i + 4]
            run[i] = run[i + 1] + 1 if same else 1
            # The run's own share replaces that of its shorter form.
            least[i] = least[i + 1] + (run[i] % 2 == 0)
    return least, systems


@lru_cache(maxsize=50_000)
def search(rows: str, entry: int = NONE, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest, ASCII-least edits from state ``entry``.

    ``rows`` has two letters a row: the role's initial (o: another) and its fault (k: none, t:
    cut short, x: must go). Without a goal the rows are a conversation's last and must end
    well; else they end in state ``goal``, with an edit that takes a row. None: no way.
    """
    n = len(rows) // 2
    if goal == NONE and entry != NONE:
        return None
    if goal == SYSTEM and not (entry == SYSTEM or entry == NONE and any(rows[2 * i] == "s" and rows[2 * i + 1] != GONE for i in range(n))):
        return None
    if n == 0 and goal is not None and goal != entry:
        return None
    least, systems = _bounds(rows)

    def ahead(i: int, state: int) -> int:
        if i < n:
            return least[i] + (systems[i] if state != NONE else max(0, systems[i] - 1))
        return INSERT * len(CLOSING[state]) if goal is None else 0

    bound, path = ahead(0, entry), []
    while True:
        failed: dict[tuple[int, int], int] = {}
        over: list[int] = []

        def descend(i: int, state: int, cost: int) -> int | None:
            """The cost of the first path within the bound; its letters are in ``path``."""
            if cost + ahead(i, state) > bound:
                over.append(cost + ahead(i, state))
                return None
            if i == n and (state in (NONE, ASSISTANT) if goal is None else state == goal):
                return cost
            if failed.get((i, state), -1) >= bound - cost or (i == n and goal is not None):
                return None
            following = FOLLOWS[state][1]
            edits = [("I", i, following, INSERT)]
            if i < n:
                initial, fault = rows[2 * i], rows[2 * i + 1]
                edits.insert(0, ("D", i + 1, state, DELETE))
                if fault != GONE:
                    extra = UNENDED if fault == CUT else 0
                    if (kept := _kept(state, initial)) is not None:
                        edits.append(("K", i + 1, kept, KEEP + extra))
                    edits.append(("R", i + 1, following, REROLE + extra))
            for letter, to, then, price in edits:
                path.append(letter)
                if (total := descend(to, then, cost + price)) is not None:
                    return total
                path.pop()
            failed[i, state] = bound - cost
            return None

        if (total := descend(0, entry, 0)) is not None:
            return total, "".join(path)
        bound = min(over)


class Way:
    """The best edits so far that end in one state: cost, audit, and the digest of the rows they leave."""

    def __init__(self, state: int = NONE):
        self.state, self.cost, self.audit, self.digest, self.first = state, 0, None, hashlib.sha256(), True

    def copy(self) -> Way:
        other = Way(self.state)
        other.cost, other.audit, other.digest, other.first = self.cost, self.audit, self.digest.copy(), self.first
        return other

    def put(self, role: str, text: str) -> None:
        if not self.first:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def apply(self, audit: str, rows: list[tuple[str, str]]) -> None:
        """Follow the letters of ``audit`` over (role, text) rows."""
        at = 0
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role, state = FOLLOWS[self.state]
            text = ""
            if letter != "I":
                if letter == "K":
                    role = rows[at][0]
                    state = _kept(self.state, role[:1])
                text = rows[at][1]
                at += 1
            self.put(role, text)
            self.state = state
        self.audit = (self.audit, audit)  # ways share what they have in common

    def letters(self) -> str:
        parts, rest = [], self.audit
        while rest:
            rest, part = rest
            parts.append(part)
        return "".join(reversed(parts))


class Conversation:
    """Rows of one conversation, in order; ``result`` is its row of the answer."""

    def __init__(self, conv_id):
        self.conv_id, self.n = conv_id, 0
        self.ways, self.rows, self.codes = [Way()], [], []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last, self.turns, self.low, self.turn = None, 0, None, None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if len(self.rows) == BLOCK:
            self._close_block()
        self.n += 1
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if repeated else "truncated" if bare[-1] not in ENDS else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        self.rows.append((role, text))
        self.codes.append((initial if initial and initial in "sua" else "o") + (CLEAN if fault is None else CUT if fault == "truncated" else GONE))

    def _close_block(self) -> None:
        """Extend the ways over a whole block: of those to a state the cheapest, then the ASCII-least.

        Ways are listed in the order of their audits, which are no beginnings of one another.
        """
        codes, best = "".join(self.codes), {}
        for rank, way in enumerate(self.ways):
            for goal in STATES:
                if (found := search(codes, way.state, goal)) is not None:
                    key = (way.cost + found[0], rank, found[1])
                    if goal not in best or key < best[goal]:
                        best[goal] = key
        ways = []
        for cost, rank, audit in sorted(best.values(), key=lambda b: b[1:]):
            way = self.ways[rank].copy()
            way.apply(audit, self.rows)
            way.cost = cost
            ways.append(way)
        self.ways, self.rows, self.codes = ways, [], []

    def result(self) -> tuple:
        codes = "".join(self.codes)
        ends = [(way.cost + found[0], rank, found[1]) for rank, way in enumerate(self.ways) if (found := search(codes, way.state)) is not None]
        cost, rank, audit = min(ends)
        way = self.ways[rank]
        way.apply(audit, self.rows)
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), cost, way.letters(), way.digest.hexdigest())


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    A dropped row stays as a mark that its conversation exists, without role and text.
    """
    blank = lambda col: F.coalesce(df[col].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), what.alias("what"))
    role = F.when(F.col("what") == 0, F.lit("")).when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("what").isin(0, 1), F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _digest() -> Column:
    """Names role and text together; the length keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def repair(damaged: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, dropped)."""
    id_type = damaged.schema["conv_id"].dataType.simpleString()
    rows = damaged.withColumn("key", _digest())
    # Where a pair of role and text came before: marks for its later turns, sorted in front of them.
    seen = rows.filter("not dropped").select("conv_id", "key", "role", "turn")
    known = F.struct(F.col("turn").isNotNull().alias("set"), "turn")  # nulls first
    repeats = seen.groupBy("conv_id", "key").agg(F.min(known).alias("first"), F.max(known).alias("last")).filter("first < last")
    repeats = repeats.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    later = seen.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).filter(known > F.col("first"))
    marks = later.select("conv_id", "turn", "role", F.lit("").alias("text"), F.lit(False).alias("dropped"), "key", F.lit(True).alias("mark")).distinct()
    stream = rows.withColumn("mark", F.lit(False)).unionByName(marks).repartition("conv_id")
    ordered = stream.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "key", F.desc("mark"))
    schema = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def pack(results: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in results], type=f.type) for i, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, results, previous, mark = None, [], None, None
        for batch in batches:
            for part in sliced(batch, 2_000, 2 << 20):
                for conv_id, turn, role, text, dropped, key, is_mark in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "key", "mark")), strict=True):
                    if talk is None or conv_id != talk.conv_id:
                        if talk:
                            results.append(talk.result())
                        talk, previous, mark = Conversation(conv_id), None, None
                    if is_mark:
                        mark = (turn, key)
                    elif not dropped:
                        here = (turn, key)
                        talk.add(turn, role, text, here == previous or here == mark)
                        previous = here
                if len(results) >= 1_000:
                    yield pack(results)
                    results = []
        if talk:
            results.append(talk.result())
        yield pack(results)

    return ordered.select("conv_id", "turn", "role", "text", "dropped", "key", "mark").mapInArrow(run, schema)


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage the rows of ``df`` and repair every conversation of it."""
    return repair(damage(df, conv_col, turn_col, role_col, text_col))
