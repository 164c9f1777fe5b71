from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from marquee.llm import turn_repair
from marquee.llm.turn_repair import Row

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows: list[Row], exits=None) -> tuple[str, int]:
    """All edit strings in the order of (cost, string)."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    queue, seen = [(0, "", 0, 0)], set()
    while True:
        cost, letters, at, place = heapq.heappop(queue)
        if at == len(rows) and place in (0, 3):
            return letters, cost
        if (at, place) in seen:
            continue
        seen.add((at, place))
        made = [("I", 3, at, step[place][x]) for x in "ua" if x in step[place]]
        if at < len(rows):
            row = rows[at]
            tail = 4 * row.repeats
            stays = tail + 3 * row.truncated
            made.append(("D", 4 + tail, at + 1, place))
            if not row.must_go:
                made += [("R", 3 + stays, at + 1, step[place][x]) for x in "ua" if x in step[place]]
                if row.initial in step[place]:
                    made.append(("K", stays, at + 1, step[place][row.initial]))
        for letter, more, to, after in made:
            heapq.heappush(queue, (cost + more, letters + letter, to, after))


def plainly(talks: list[tuple]) -> dict:
    """The whole contract, row by row."""
    rows = defaultdict(list)
    for conv, turn, role, text in talks:
        mine = rows[conv]
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        role, text = said[2:]
        chance = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        if chance == 0:
            continue
        text = "" if chance == 1 else text.translate({ord(c): None for c in ".!?"}) if chance == 2 else text
        role = "user" if chance == 4 else role
        mine += [(turn, role, text)] * (2 if chance == 3 else 1)
    out = {}
    for conv, mine in rows.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, faults = set(), [], []
        for _, role, text in mine:
            bare = text.strip(BLANKS)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
            seen.add((role, text))
            faults.append(fault)
            kinds.append(Row(role[:1], fault in "bd", fault == "t", 0))
        letters, cost = cheapest(kinds)
        lines, at, state = [], 0, ""
        for letter in letters:
            due = "a" if state == "u" else "u"
            if letter == "I":
                lines.append({"u": "user", "a": "assistant"}[due] + ":")
                state = due
                continue
            _, role, text = mine[at]
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = role[:1]
            elif letter == "R":
                lines.append({"u": "user", "a": "assistant"}[due] + f":{text}")
                state = due
            at += 1
        turns = [t for t, _, _ in mine if t is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False)),
            cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def some_talks() -> list[tuple]:
    r = random.Random(5)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \n", "Héé 日本.", "x" * 3000 + ".", "end.\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    talks = []
    for conv in [*range(120), None]:
        for i in range(r.randint(1, 12)):
            turn = r.choice([i, i, i, r.randint(0, 9), None])
            role = ("user", "assistant")[i % 2] if r.random() < 0.6 else r.choice(roles)
            talks.append((conv, turn, role, r.choice(texts) if r.random() < 0.5 else f"Text {r.random()}."))
    # one conversation holds a third of all rows, one is a single repeated row, one is without turns
    talks += [(500, i, ("user", "assistant", "system")[r.choice([0, 1, 0, 1, 2])],
               r.choice(["Same.", f"Text {i}", f"Text {i}."])) for i in range(400)]
    talks += [(501, 7, "user", "Again and again.")] * 60
    talks += [(502, None, r.choice(roles), f"{i % 9}.") for i in range(40)]
    r.shuffle(talks)
    return talks


def check(found, talks: list[tuple]) -> None:
    expected = plainly(talks)
    rows = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    assert set(rows) == {t[0] for t in talks}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv, row in rows.items():
        assert row == expected.get(conv, nothing), conv


def test_repair_equals_the_plain_form(spark):
    talks = some_talks()
    check(turn_repair.repair(spark.createDataFrame(talks, SCHEMA).repartition(5)), talks)


def test_a_lost_row_leaves_zeros(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    talks = [(lost, 0, "user", "Gone."), (1 << 60, 3, "user", "Large id."), (None, None, None, None)]
    check(turn_repair.repair(spark.createDataFrame(talks, SCHEMA)), talks)


def test_other_names_and_columns(spark):
    talks = some_talks()[:200]
    named = "c long, t long, r string, x string, times int, talk string, place int, conv_id string"
    frame = spark.createDataFrame([(*t, 9, "talk", 1, "other") for t in talks], named)
    check(turn_repair.repair(frame, "c", "t", "r", "x"), talks)


def test_empty_table(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def odd_rows(r: random.Random, size: int) -> list[Row]:
    return [Row(r.choice("suuuaaat"), r.random() < 0.1, r.random() < 0.15, r.choice([0, 0, 0, 1, 2]))
            for _ in range(size)]


def spelled(rows: list[Row], letters: str) -> str:
    out, at = "", 0
    for letter in letters:
        out += letter
        if letter != "I":
            out += "D" * rows[at].repeats
            at += 1
    return out


def test_the_search_finds_the_cheapest_and_then_least_string():
    r = random.Random(1)
    for _ in range(1500):
        rows = odd_rows(r, r.randint(0, 9))
        assert turn_repair.search(rows)[:2] == cheapest(rows)


def test_blocks_make_what_the_whole_makes():
    r = random.Random(2)
    for _ in range(300):
        rows = odd_rows(r, r.randint(3, 30))
        cuts = sorted({0, len(rows), *(r.randint(1, len(rows)) for _ in range(3))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        exits, costs = [None], list(turn_repair.AT_END)
        for part in parts[:0:-1]:
            own = turn_repair.between(part)
            costs = [min(own[s][e] + costs[e] for e in range(4)) for s in range(4)]
            exits.append(costs)
        letters, place, total = "", turn_repair.START, None
        for part, after in zip(parts, exits[::-1], strict=True):
            found, cost, place = turn_repair.search(part, place, after)
            letters, total = letters + found, cost if total is None else total
        assert (letters, total) == cheapest(rows)
        assert len(spelled(rows, letters)) == len(letters) + sum(x.repeats for x in rows)
