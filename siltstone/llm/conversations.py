"""Repair of conversation structure: cheapest edits that make the roles match (s?(ua)+)?.

Turns are kept (cost 0), given the role user or assistant (Rerole, 2) or deleted (3); user or
assistant turns without text are inserted anywhere (2). Blank turns and repeats of an earlier role
and text must go; a turn that stays and whose last visible character is not . ! or ? costs 1.

The grammar has four states: nothing yet, after a system turn, after a user turn, after an
assistant turn. State and edit fix what follows (a rerole or an insertion gives the role that the
state asks for), so a string of edits fixes the repaired conversation. The cost to go from a turn and a
state to the end is worked out backwards, one turn at a time; then a walk forwards takes at each
place the edit with the least letter among those that lose nothing: the ASCII-least cheapest string.
Only differences between the four costs matter to choices, and a turn is one of nine symbols, so both
passes are automata whose few transitions a worker works out once and remembers.

Each conversation's turns share a task, in one shuffle: sorted backwards for the costs, sorted
forwards for the walk (Spark's sorts spill). Both passes read batches as they come and hold one turn and
the running digest, whatever a conversation's length; a conversation is walked by one task since it
has one digest. Nothing is gathered to a list.

Cases: null role and text are a single space; rows are ordered by turn (null first), then role and
text as they came, a repetition after its original; equal rows are interchangeable. Roles count by
their first letter, as it is written; a kept turn keeps its role's spelling. A null conv_id is a
conversation of its own; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.worker import tidy
from siltstone.session import ship, small_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Of each state (start, after s, after u, after a): the role that may follow besides a system turn, and its state.
_NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_FINAL = (0, 3)
_FAR = 1 << 40
_SPACE = " \t\n\v\f\r"
#: Symbols: 0 must go; else 1 + 2 * (place of the role's first letter, 3 for others) + whether truncated.
_LETTERS = "sua"


def _kept(state: int, symbol: int) -> int | None:
    """The state after a turn kept as it is; None where its role may not follow."""
    letter = (symbol - 1) // 2
    if letter == 0:
        return 1 if state == 0 else None
    if letter == 3 or _NEXT[state][0][0] != _LETTERS[letter]:
        return None
    return _NEXT[state][1]


def _edits(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn, by letter: (letter, cost, following state)."""
    yield "D", DELETE, state
    if symbol:
        extra = TRUNCATED if symbol % 2 == 0 else 0
        after = _kept(state, symbol)
        if after is not None:
            yield "K", extra, after
        yield "R", REROLE + extra, _NEXT[state][1]


def _with_insertions(costs: list[int]) -> list[int]:
    """Costs of the states where turns may be inserted first (two at most help)."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_NEXT[s][1]]) for s, c in enumerate(costs)]
    return costs


END = tuple(_with_insertions([0 if s in _FINAL else _FAR for s in range(4)]))


def cost_before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from each state before a turn, given those after it."""
    return tuple(_with_insertions([min(c + after[t] for _, c, t in _edits(s, symbol)) for s in range(4)]))


def step(symbol: int | None, state: int, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """The edits from a state over one turn (None: the end), least letters first, and the following state."""
    out, left = "", before[state]
    while True:
        tight = [e for e in (_edits(state, symbol) if symbol is not None else ()) if e[1] + after[e[2]] == left]
        following = _NEXT[state][1]
        if INSERT + before[following] == left:
            tight.append(("I", INSERT, following))
        if not tight:  # at the end, with nothing left to pay
            return out, state
        letter, cost, following = min(tight)
        out, left, state = out + letter, left - cost, following
        if letter != "I":
            return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, r0, t0 (as they came) and again (1: a repetition), after the damage that a turn's checksum names."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("r0"), said("text").alias("t0"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("t0", "[.!?]", "")).otherwise(F.col("t0"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("r0"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), "r0", "t0", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))


def _symbols(rows: DataFrame) -> DataFrame:
    """Adds fault (0 none, 1 blank, 2 duplicate, 3 truncated) and sym. Every window lies within a conversation, so all share one shuffle."""
    order = [F.col("turn").asc_nulls_first(), F.col("r0"), F.col("t0"), F.col("again")]
    dealt = rows.repartition(F.col("conv"))
    placed = dealt.withColumn("earlier", F.row_number().over(Window.partitionBy("conv", "role", F.sha2("text", 256)).orderBy(*order)) - 1)
    seen = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(seen == "", 1).when(F.col("earlier") > 0, 2).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    letter = F.substring("role", 1, 1)
    place = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return placed.withColumn("fault", fault).withColumn("sym", F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * place + (F.col("fault") == 3).cast("int")))


_ROW = "conv long, turn long, role string, text string, r0 string, t0 string, again int, earlier int, fault int, sym int"


def _backwards():
    """Adds to each turn the costs to go after it, less their minimum (go0 to go3), and on a conversation's first turn the total from the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        conv, costs, base = object(), END, 0
        for batch in batches:
            convs, symbols = batch.column("conv").to_pylist(), batch.column("sym").to_pylist()
            after, total = [], []
            for c, s in zip(convs, symbols):
                if c != conv:
                    conv, costs, base = c, END, 0
                after.append(costs)
                if (costs, s) not in known:
                    before = cost_before(s, costs)
                    known[costs, s] = tuple(b - min(before) for b in before), min(before)
                costs, more = known[costs, s]
                base += more
                total.append(base + costs[0])
            columns = [pa.array([a[i] for a in after], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(total, pa.int64())], [*batch.schema.names, "go0", "go1", "go2", "go3", "total"])

    return run


class _Walk:
    """One conversation's walk: what has been seen, edited and digested so far."""

    def __init__(self, conv, total: int):
        self.conv, self.total = conv, total
        self.state, self.audit, self.counts = 0, [], [0, 0, 0, 0]
        self.least = self.most = self.last = None
        self.turns = self.illegal = 0
        self.before_role: str | None = None
        self.digest, self.begun = hashlib.sha256(), False
        self.lines: list[str] = []

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.counts[1:], self.illegal, self.total, "".join(self.audit), self.digest.hexdigest()


_OUT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _forwards(lines: bool):
    """One row a conversation; with ``lines``, a row a repaired turn instead (place, edit, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        walk: _Walk | None = None
        out: list[tuple] = []

        def put(edits: str, role: str | None, text: str | None) -> None:
            """What a step's edits make of the turn: inserted turns first, then the turn itself."""
            state = walk.state
            for e in edits:
                if e == "D":
                    continue
                asked, following = _NEXT[state]
                kept = e == "K"
                if kept and role[:1] == "s":
                    following = 1
                said, what = (role if kept else asked), ("" if e == "I" else text)
                if lines:
                    walk.turns += 1
                    out.append((walk.conv, walk.turns - 1, e, said, what))
                else:
                    walk.line(said, what)
                state = following
            walk.state = state

        def close() -> None:
            if walk is None:
                return
            edits, _ = step(None, walk.state, END, END)
            put(edits, None, None)
            if not lines:
                walk.audit.append(edits)
                out.append(walk.row())

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        text_type = pa.string()
        if lines:
            schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", text_type), ("role", text_type), ("text", text_type)])
        else:
            schema = pa.schema([("conv", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", text_type), ("repaired_sha256", text_type)])
        names = ("conv", "turn", "role", "text", "fault", "sym", "go0", "go1", "go2", "go3", "total")
        for batch in batches:
            for conv, turn, role, text, fault, symbol, *after, total in zip(*(batch.column(n).to_pylist() for n in names)):
                if walk is None or conv != walk.conv:
                    close()
                    walk = _Walk(conv, total)
                if not lines:
                    walk.counts[fault] += 1
                    if turn is not None and turn != walk.last:
                        walk.least, walk.most, walk.last, walk.turns = (turn if walk.least is None else walk.least), turn, turn, walk.turns + 1
                    if walk.before_role is not None and walk.before_role + role[:1] not in ("su", "ua", "au"):
                        walk.illegal += 1
                    walk.before_role = role[:1]
                key = (symbol, walk.state, *after)
                if key not in known:
                    known[key] = step(symbol, walk.state, cost_before(symbol, tuple(after)), tuple(after))[0]
                put(known[key], role, text)
                if not lines:
                    walk.audit.append(known[key])
            yield batch_of()
        close()
        yield batch_of()

    return run


def _walked(rows: DataFrame, lines: bool) -> DataFrame:
    ship(rows.sparkSession)
    small_batches(rows.sparkSession)
    # Equal rows differ in ``earlier`` alone: both sorts must agree on them.
    ties = ["r0", "t0", "again", "earlier"]
    marked = _symbols(rows).sortWithinPartitions(F.col("conv").asc(), F.col("turn").desc_nulls_last(), *[F.col(c).desc() for c in ties])
    costs = marked.select(*[f.split(" ")[0] for f in _ROW.split(", ")]).mapInArrow(tidy(_backwards()), _ROW + ", go0 long, go1 long, go2 long, go3 long, total long")
    ahead = costs.sortWithinPartitions(F.col("conv").asc(), F.col("turn").asc_nulls_first(), *ties)
    return ahead.mapInArrow(tidy(_forwards(lines)), "conv long, place long, edit string, role string, text string" if lines else _OUT)


def repaired(rows: DataFrame) -> DataFrame:
    """conv, place, edit (K, R or I), role and text of every turn of the repaired conversations.

    ``rows``: conv, turn, role, text, r0, t0, again, as ``damaged`` gives them (for a table as it is r0
    and t0 equal role and text, and again is 0).
    """
    return _walked(rows, True)


def repair_summary(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""
    return _walked(rows, False)


def audit(conversations: DataFrame) -> DataFrame:
    """Damage, then repair: one row for every conv_id of the table, also where no turn is left."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_summary(damaged(conversations))
    full = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
