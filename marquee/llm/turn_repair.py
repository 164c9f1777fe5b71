"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation should read: perhaps a system turn, then pairs of user and assistant.  Edits take its rows
there: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an empty turn (3); a truncated row that
stays costs 3 more, blank and repeated rows must go.  The state of a search is (row, place in the
pattern).  A depth-first search tries edits in ASCII order under a cost bound; states that failed keep the
cost they are now known to need (the transposition table), and the bound rises to the least cost that
exceeded it.  The first path accepted is the cheapest and, among those, the ASCII-least.  The estimate
of a state is exact within its window of four rows and takes the cheapest place at each later border.

Rows are brought into order by ranges, and equal rows are one row with a count, so a conversation that
holds a third of all rows lies in many tasks.  It is cut into blocks.  A block yields its costs between
any two places; their sums from the end give each block the exact cost of all that follows, every block is
searched for each place it may be entered at, and the places are then followed from the start.  Block
strings all end with the edit of the last row, so none is the beginning of another, and the least string
of each block makes the least string of all.  Only the digest and the audit of a conversation are put
together in one task, block by block.

Defined results: NULL roles and texts, and NULL ids and turns inside the damage key, are one space; rows
without conv_id are one conversation, whose id is NULL; rows of one turn are taken in the order of role,
then text, and NULL turns come first; texts of any length are kept whole; further columns are ignored, the
four needed may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from marquee.llm.common import keep, small_batches

# the white space of the contract
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# places in the pattern (s?(ua)+)?: before everything, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
PLACES = 4
NEXT_ROLE = ("u", "u", "a", "u")  # what is inserted, or made by a new role, at each place
ROLES = {"u": "user", "a": "assistant"}
AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
# cheapest way to an accepted end by inserts alone
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60

WINDOW = 4
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 16


class Row(NamedTuple):
    """What the search knows of a row; ``repeats`` equal rows follow it and must go."""

    initial: str
    must_go: bool
    truncated: bool
    repeats: int


def _moves(row: Row, place: int) -> list[tuple[str, int, int]]:
    """Edits that take the row, in ASCII order: (letter, cost, place afterwards)."""
    tail = DELETE * row.repeats
    out = [("D", DELETE + tail, place)]
    if not row.must_go:
        stays = tail + (TRUNCATED if row.truncated else 0)
        if row.initial == NEXT_ROLE[place] or (row.initial == "s" and place == START):
            out.append(("K", stays, AFTER[row.initial]))
        out.append(("R", stays + REROLE, AFTER[NEXT_ROLE[place]]))
    return out


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs to go from each place if turns may be inserted first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[AFTER[NEXT_ROLE[p]]]) for p, c in enumerate(costs)]
    return costs


def _back(row: Row, costs: list[int]) -> list[int]:
    """Costs to go before a row from those behind it."""
    return _with_inserts([
        min(cost + costs[after] for _, cost, after in _moves(row, place)) for place in range(PLACES)
    ])


def between(rows: list[Row]) -> list[list[int]]:
    """Least cost of a block from each place to each place, no turn inserted behind its last row."""
    columns = []
    for end in range(PLACES):
        costs = [0 if place == end else NEVER for place in range(PLACES)]
        for row in reversed(rows):
            costs = _back(row, costs)
        columns.append(costs)
    return [[min(columns[end][start], NEVER) for end in range(PLACES)] for start in range(PLACES)]


def _estimates(rows: list[Row], exits: list[int]) -> list[list[int]]:
    """A lower bound of the cost to go at each (row, place)."""
    costs = [min(exits)] * PLACES
    out = [costs]
    for at in range(len(rows) - 1, -1, -1):
        costs = _back(rows[at], costs)
        out.append(costs)
        if at % WINDOW == 0:
            costs = [min(costs)] * PLACES
    return out[::-1]


def search(rows: list[Row], start: int = START, exits: list[int] | None = None) -> tuple[str, int, int]:
    """The cheapest, then ASCII-least edits of a block: (letters, cost with what follows, last place).

    ``exits`` is the cost of everything after the block for each place; without it the block is the last
    one and turns may be inserted at its end.
    """
    last = exits is None
    known = _estimates(rows, list(AT_END) if last else exits)
    size = len(rows)
    known[size] = list(AT_END) if last else list(exits)
    moves: dict[tuple[int, int], list[tuple[str, int, int, int]]] = {}

    def edits(at: int, place: int) -> list[tuple[str, int, int, int]]:
        found = moves.get((at, place))
        if found is None:
            insert = ("I", INSERT, at, AFTER[NEXT_ROLE[place]])
            if at == size:
                found = [insert] if last else []
            else:
                taking = [(letter, cost, at + 1, after) for letter, cost, after in _moves(rows[at], place)]
                found = [taking[0], insert, *taking[1:]]
            moves[at, place] = found
        return found

    def accepts(at: int, place: int, budget: int) -> bool:
        if at < size:
            return False
        return place in (START, AFTER_A) if last else exits[place] <= budget

    bound = known[0][start]
    while True:
        # of each state on the path: row, place, budget, edits left to try, least cost seen to fail
        path = [(0, start, bound, iter(edits(0, start)))]
        least = [NEVER]
        letters: list[str] = []
        found = accepts(0, start, bound)
        while path and not found:
            at, place, budget, left = path[-1]
            for letter, cost, to, after in left:
                needs = cost + known[to][after]
                if needs > budget:
                    least[-1] = min(least[-1], needs)
                    continue
                letters.append(letter)
                path.append((to, after, budget - cost, iter(edits(to, after))))
                least.append(NEVER)
                found = accepts(to, after, budget - cost)
                break
            else:
                # failed: the state needs more than its budget, at least what its edits need now
                needs = max(known[at][place], min(least.pop(), NEVER))
                known[at][place] = needs
                path.pop()
                if path:
                    parent = path[-1]
                    spent = parent[2] - budget
                    least[-1] = min(least[-1], spent + needs)
                    letters.pop()
        if found:
            return "".join(letters), bound, path[-1][1]
        bound = known[0][start]


def damaged(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): the rows after damage, equal rows as one with their number."""
    space = F.lit(" ")

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    chance = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = talks.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"),
        said(text).alias("text"), chance.alias("chance"),
    ).filter("chance <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("chance") == 1, "")
        .when(F.col("chance") == 2, F.translate("text", ENDINGS, ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("chance") == 3, 2).otherwise(1).alias("times"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def judged(rows: DataFrame) -> DataFrame:
    """Add the fault of each row's first copy: b(lank), d(uplicate), t(runcated) or none."""
    end = F.rtrim("text", F.lit(BLANKS))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    told = rows.withColumns({
        "talk": F.struct("conv_id"), "place": place, "digest": F.sha2("text", 256),
    })
    first = told.groupBy("talk", "role", "digest").agg(F.min("place").alias("first"))
    fault = (
        F.when(end == "", "b").when(F.col("place") > F.col("first"), "d")
        .when(~F.substring(end, -1, 1).isin(*ENDINGS), "t").otherwise(".")
    )
    return told.join(first, ["talk", "role", "digest"]).select(
        "conv_id", "turn", "role", "text", "times", fault.alias("fault")
    )


def _known(roles: list[str], faults: str, times: list[int]) -> list[Row]:
    return [Row(role[:1], fault in "bd", fault == "t", int(n) - 1)
            for role, fault, n in zip(roles, faults, times, strict=True)]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


# what is counted in a conversation, by block
COUNTED = ["blank", "duplicate", "truncated", "illegal", "turns"]
BLOCK = ", ".join([
    "conv_id long", "part int", "block long", "roles array<string>", "texts array<string>",
    "times array<long>", "faults string", *[f"{name} long" for name in COUNTED],
    "low long", "high long", "costs array<long>",
])
FOUND = ", ".join([
    "conv_id long", "gaps long", *[f"{name} long" for name in COUNTED[:-1]],
    "cost long", "audit string", "repaired_sha256 string",
])


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(schema), dtype=object)


Batches = Iterator[pd.DataFrame]


def _mapped(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """mapInPandas with whole numbers kept whole where some are NULL."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(batch.to_pandas(types_mapper=whole.get) for batch in given):
            yield pa.RecordBatch.from_pandas(frame, wanted, preserve_index=False)

    return df.mapInArrow(batches, schema)


def _numbers(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in column]


def _legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def _blocks(batches: Batches) -> Batches:
    """Cut ordered rows into blocks of one conversation each."""
    part, made, chars, talk = TaskContext.get().partitionId(), 0, 0, None
    held: list[tuple] = []

    def block() -> tuple:
        turns, roles, texts, times, faults = (list(x) for x in zip(*held, strict=True))
        copies = sum(times) - len(times)
        blank = sum(n for n, fault in zip(times, faults, strict=True) if fault == "b")
        gone = sum(n for n, fault in zip(times, faults, strict=True) if fault == "d")
        again = sum(n - 1 for n, fault in zip(times, faults, strict=True) if fault in ".t")
        illegal = copies + sum(not _legal(a, b) for a, b in zip(roles, roles[1:], strict=False))
        known = [t for t in turns if t is not None]
        costs = [c for row in between(_known(roles, faults, times)) for c in row]
        return (talk, part, made, roles, texts, times, "".join(faults), blank, gone + again,
                faults.count("t"), illegal, len(set(known)), min(known, default=None),
                max(known, default=None), costs)

    for batch in batches:
        out = []
        for conv, *row in zip(
            _numbers(batch["conv_id"]), _numbers(batch["turn"]), batch["role"], batch["text"],
            map(int, batch["times"]), batch["fault"], strict=True,
        ):
            if held and (conv != talk or len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                out.append(block())
                made, held, chars = made + 1, [], 0
            talk = conv
            held.append(tuple(row))
            chars += len(row[2])
        if out:
            yield _frame(out, BLOCK)
    if held:
        yield _frame([block()], BLOCK)


def _known(roles, faults, times) -> list[Row]:
    """What the search needs of a block's rows."""
    return [Row(role[:1], fault in "bd", fault == "t", int(n) - 1)
            for role, fault, n in zip(roles, faults, times, strict=True)]


def blocks(talks: DataFrame) -> DataFrame:
    """Blocks of ordered rows, written once; ``talks`` are the rows of `damaged`."""
    order = ["conv_id", "turn", "role"]
    small_batches(talks.sparkSession)
    # long texts of one place would make long cut points, and agree in their beginnings at most
    ordered = (
        judged(talks).repartitionByRange(*order, F.substring("text", 1, 64))
        .sortWithinPartitions(*order, "text")
    )
    return keep(_mapped(ordered, _blocks, BLOCK), "turns")


def _exits(batches: Batches) -> Batches:
    """Blocks from the last to the first: what everything behind each block costs."""
    talk, costs, fresh = None, [], True
    for batch in batches:
        out = []
        for conv, part, block, own in zip(
            _numbers(batch["conv_id"]), batch["part"], batch["block"], batch["costs"], strict=True
        ):
            last = fresh or conv != talk
            out.append((part, block, [] if last else costs))
            behind = list(AT_END) if last else costs
            costs = [min(int(own[PLACES * s + e]) + behind[e] for e in range(PLACES))
                     for s in range(PLACES)]
            talk, fresh = conv, False
        yield _frame(out, "part, block, exits")


def _edited(batches: Batches) -> Batches:
    """The edits of a block for each place it may be entered at."""
    for batch in batches:
        letters, costs, ends = [], [], []
        for roles, faults, times, exits in zip(
            batch["roles"], batch["faults"], batch["times"], batch["exits"], strict=True
        ):
            after = [int(c) for c in exits] or None
            rows = _known(roles, faults, times)
            found = [search(rows, place, after) for place in range(PLACES)]
            letters.append([f[0] for f in found])
            costs.append([f[1] for f in found])
            ends.append([f[2] for f in found])
        yield batch.drop(columns=["exits", "costs"]).assign(letters=letters, costs=costs, ends=ends)


def _lines(roles, texts, letters: str, place: int) -> Iterator[str]:
    """Repaired lines of a block entered at a place."""
    at = 0
    for letter in letters:
        role = NEXT_ROLE[place]
        if letter == "I":
            yield f"{ROLES[role]}:"
        elif letter == "R":
            yield f"{ROLES[role]}:{texts[at]}"
        elif letter == "K":
            yield f"{roles[at]}:{texts[at]}"
            role = roles[at][:1]
        if letter != "D":
            place = AFTER[role]
        at += letter != "I"


def _spelled(letters: str, times) -> str:
    """The audit of a block: copies that follow a row are deleted behind it."""
    out, at = [], 0
    for letter in letters:
        out.append(letter)
        if letter != "I":
            out.append("D" * (int(times[at]) - 1))
            at += 1
    return "".join(out)


class _Talk:
    """What is put together of one conversation, block by block."""

    def __init__(self):
        self.digest, self.lines, self.audit = hashlib.sha256(), 0, []
        self.counts = dict.fromkeys(COUNTED, 0)
        self.low = self.high = self.role = self.cost = None
        self.place = START

    def add(self, block, letters: str, cost: int, end: int) -> None:
        for line in _lines(block.roles, block.texts, letters, self.place):
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1
        self.audit.append(_spelled(letters, block.times))
        for name in COUNTED:
            self.counts[name] += int(getattr(block, name))
        if self.role is None:
            self.cost = cost
        elif not _legal(self.role, block.roles[0]):
            self.counts["illegal"] += 1
        if not pd.isna(block.low):
            # rows are in the order of turns, so only the border turn can be in both
            self.counts["turns"] -= self.high == int(block.low)
            self.low = int(block.low) if self.low is None else self.low
            self.high = int(block.high)
        self.role, self.place = block.roles[-1], end

    def row(self, conv: int | None) -> tuple:
        turns = self.counts.pop("turns")
        gaps = 0 if self.low is None else self.high - self.low + 1 - turns
        return (conv, gaps, *self.counts.values(), self.cost, "".join(self.audit),
                self.digest.hexdigest())


def _whole(batches: Batches) -> Batches:
    """Conversations of one block."""
    for batch in batches:
        out = []
        for conv, block in zip(_numbers(batch["conv_id"]), batch.itertuples(), strict=True):
            talk = _Talk()
            talk.add(block, *search(_known(block.roles, block.faults, block.times)))
            out.append(talk.row(conv))
        yield _frame(out, FOUND)


def _joined(batches: Batches) -> Batches:
    """Conversations of several blocks, which come in order."""
    talk, now = None, None
    for batch in batches:
        out = []
        for conv, block in zip(_numbers(batch["conv_id"]), batch.itertuples(), strict=True):
            if talk is None or conv != now:
                if talk is not None:
                    out.append(talk.row(now))
                talk, now = _Talk(), conv
            at = talk.place
            talk.add(block, block.letters[at], int(block.costs[at]), int(block.ends[at]))
        yield _frame(out, FOUND)
    if talk is not None:
        yield _frame([talk.row(now)], FOUND)


def repaired(held: DataFrame) -> DataFrame:
    """One row per conversation that has blocks: its counts, cost, audit and repaired digest."""
    talk = F.struct("conv_id")
    held = held.withColumn("talk", talk)
    several = held.groupBy("talk").agg(F.count("*").alias("n")).filter("n > 1").select("talk")
    whole = held.join(several, "talk", "left_anti").drop("talk")

    long = held.join(several, "talk", "left_semi")
    backwards = (
        long.select("conv_id", "part", "block", "costs").repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    )
    exits = _mapped(backwards, _exits, "part int, block long, exits array<long>")
    entered = long.drop("talk").join(exits, ["part", "block"]).select(*_names(BLOCK), "exits")
    fields = [field for field in BLOCK.split(", ") if not field.startswith("costs")]
    edited = ", ".join([*fields, "letters array<string>", "costs array<long>", "ends array<long>"])
    forwards = (
        _mapped(entered, _edited, edited).repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "block")
    )
    return _mapped(whole, _whole, FOUND).unionByName(_mapped(forwards, _joined, FOUND))


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Damage, then repair: one row per conversation of ``talks``, also if the damage left no row."""
    found = repaired(blocks(damaged(talks, conv, turn, role, text)))
    ids = talks.select(F.struct(F.col(conv).alias("conv_id")).alias("talk")).distinct()
    names = _names(FOUND)[1:]
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return ids.join(
        found.select(F.struct("conv_id").alias("talk"), *names), "talk", "left"
    ).select(
        F.col("talk.conv_id").alias("conv_id"),
        *[F.coalesce(n, empty.get(n, F.lit(0))).alias(n) for n in names],
    )
