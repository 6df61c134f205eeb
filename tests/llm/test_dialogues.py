"""Repairs of conversations against an exhaustive plain version."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from veilframe.llm.dialogues import ASSISTANT, START, SYSTEM, USER, Joined, Turns, apply_edits, cheapest, damage, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_cheapest(turns):
    """Uniform cost search over whole edit strings, the least (cost, string) first."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        state = (i, roles[-1:], len(roles) > 0)
        if state in done:
            continue
        done.add(state)
        options = [("I", 5, i, r) for r in "ua"]
        if i < len(turns):
            initial, fault = turns[i]
            options.append(("D", 2, i + 1, ""))
            if fault not in "bd":
                late = 5 if fault == "t" else 0
                options += [("K", late, i + 1, initial), *(("R", 1 + late, i + 1, r) for r in "ua")]
        for letter, price, j, role in options:
            new = roles + role
            if (role or letter == "D") and re.fullmatch("(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + price, audit + letter, j, new))
    raise AssertionError


def plain(rows):
    """The contract, one conversation after the other; ties of turns by role and text."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, shape = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else " "
            seen.add((role, text))
            shape.append((role[:1], fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, f in shape) for x in "bdt"]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(shape, shape[1:]))
        cost, audit = plain_cheapest(shape)
        text = "\n".join(apply_edits(audit, [(r, t) for _, r, t in own]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shapes(seed, count, longest):
    random.seed(seed)
    return [[(random.choice("suuaaax "), random.choice("     bdt")) for _ in range(random.randint(0, longest))] for _ in range(count)]


def test_cheapest():
    for shape in shapes(1, 300, 9):
        assert cheapest(shape) == plain_cheapest(shape), shape


def test_long_shapes_take_bounded_work():
    for shape in shapes(2, 3, 128):
        assert cheapest(shape) == plain_cheapest(shape)


def test_joined_segments_equal_the_whole():
    for shape in shapes(3, 200, 14):
        joined = Joined()
        for at in range(0, len(shape), 3):
            part = shape[at : at + 3]
            ways = {}
            for a in (START, SYSTEM, USER, ASSISTANT):
                for b in (START, SYSTEM, USER, ASSISTANT):
                    possible = {START: True, SYSTEM: a == SYSTEM or (a == START and any(i == "s" and f in " t" for i, f in part))}.get(b, True)
                    if possible and (b != START or a == START):
                        ways[a, b] = cheapest(part, a, (b,))
            joined.then(Turns(), ways)
        assert joined.result() == cheapest(shape)


def test_apply_edits():
    rows = [("system", "s"), ("user", "q"), ("user", "r"), ("x", "t")]
    assert list(apply_edits("KKRIR", rows)) == ["system:s", "user:q", "assistant:r", "user:", "assistant:t"]
    assert list(apply_edits("DDDD", rows)) == []


@pytest.fixture(scope="module")
def odd():
    random.seed(5)
    words = ["Yes.", "no", "", None, " ", "A!", "b. \n", "c", "ünï?"]
    rows = [
        (random.choice([*range(25), None]), random.choice([*range(12), None]), random.choice(["user", "assistant", "system", None, "", "User"]), random.choice(words))
        for _ in range(900)
    ]
    rows += [(500, t, random.choice(["user", "assistant"]), f"text {t % 40}{random.choice('.x')}") for t in range(700)]  # one holds a third
    return rows + rows[:40] + [(900 + i, t, "user", "Hm.") for i in range(60) for t in range(2)] + [(2000, 0, "user", "long " * 50_000 + ".")]


@pytest.mark.parametrize("segment", [2, 32, 500])
def test_repair_of_odd_rows(spark, odd, segment):
    df = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 as cost", "'x' as part", "2 as place")
    assert rows_of(repair(damage(df.repartition(5)), segment)) == plain(odd)


def test_empty_table(spark):
    assert rows_of(repair(damage(spark.createDataFrame([], SCHEMA)))) == []


def test_given_table(spark):
    from veilframe.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_dialogues"](spark, SF)) == plain(rows)
