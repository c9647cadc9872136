"""Repaired conversations against a plain program over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogues
from tidemark.llm.queries import QUERIES

BARE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (kind != 0) * (1 + (kind == 3))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def plain(rows):
    """Cost, edits and repaired lines of one conversation in order, by trying all edits."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        found = BARE.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, said, room):
        """The least cost and edits from row ``i`` on after ``said``, with ``room`` turns still to be put in."""
        ways = []
        if i == len(rows):
            if said in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            cost, edits, lines = best(i + 1, said, 2)
            ways.append((cost + 4, "D" + edits, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if role[:1] and role[:1] in step[said]:
                    cost, edits, lines = best(i + 1, role[:1], 2)
                    ways.append((cost + more, "K" + edits, (f"{role}:{text}", *lines)))
                for other in ("user", "assistant"):
                    if other[0] in step[said]:
                        cost, edits, lines = best(i + 1, other[0], 2)
                        ways.append((cost + 3 + more, "R" + edits, (f"{other}:{text}", *lines)))
        if room:
            for other in ("user", "assistant"):
                if other[0] in step[said]:
                    cost, edits, lines = best(i, other[0], room - 1)
                    ways.append((cost + 3, "I" + edits, (f"{other}:", *lines)))
        return min(ways, default=(1 << 50, "", ()))

    cost, audit, lines = best(0, "", 2)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    by_id = defaultdict(list)
    for row in damage(rows):
        by_id[row[0]].append(row)
    return {conv: plain(tuple(in_order(by_id[conv]))) for conv in {r[0] for r in rows}}


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r[1:] for r in found}


def conversations(seed, n, longest):
    draw = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", "Human", None], ["Yes.", "no", "Why?", " ", "", "\n", None, "a b!", "中。", "ok.\n ", "x" * 50]
    for conv in [None, *range(n)]:
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = draw.choice(texts) if draw.random() < 0.5 else f"turn {draw.randrange(99)}{draw.choice(['.', '', '!'])}"
            at = None if draw.random() < 0.05 else turn + draw.choice([0, 0, 0, 1, 1 << 40])
            yield from [(conv, at, role, text)] * draw.choice([1, 1, 1, 1, 2])


SCHEMA = "conv_id long, turn long, role string, text string"


def test_the_query_repairs_as_a_plain_version(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op12_conversation_repair"](spark, data)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {kind for _, kind in df.dtypes[1:7]} == {"bigint"}
    assert got(df) == expected(rows)


@pytest.mark.parametrize("rows_per_block", [1 << 16, 6])
def test_odd_conversations_whole_and_cut(spark, rows_per_block):
    rows = list(conversations(3, 40, 30))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("taken") for n in ("key", "code", "copies", "block", "place", "rows")})
    assert got(dialogues.repairs(df, rows_per_block)) == expected(rows)


def test_one_long_conversation_in_many_blocks(spark):
    rows = list(conversations(8, 1, 900))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(dialogues.repairs(df, 25)) == expected(rows)


def test_many_copies_are_one_row(spark):
    rows = [(1, 0, "user", "Hi.")] * 30 + [(1, 1, "assistant", "Yes?")] + [(2, 5, "user", "Hi.")] * 5
    found = got(dialogues.repair(spark.createDataFrame(rows, SCHEMA)).report(spark.createDataFrame(rows, SCHEMA)))
    assert found == {c: plain(tuple(in_order([r for r in rows if r[0] == c]))) for c in (1, 2)}


def test_nothing_left_and_nothing_there(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogues.repairs(empty).collect() == []
    ids = spark.createDataFrame([(7,), (None,)], "conv_id long")
    none = hashlib.sha256(b"").hexdigest()
    assert got(dialogues.repair(empty).report(ids)) == {c: (0, 0, 0, 0, 0, 0, "", none) for c in (7, None)}


def test_turns_at_both_ends_of_the_numbers(spark):
    rows = [(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B.")]
    (row,) = dialogues.repair(spark.createDataFrame(rows, SCHEMA)).report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.gaps == 0 and row.audit == "KK"  # a difference that no long can hold counts as none


def test_lines_are_the_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "")]
    lines = dialogues.repair(spark.createDataFrame(rows, SCHEMA)).lines().orderBy("place").collect()
    assert [(r.role, r.text, r.opens) for r in lines] == [("system", "Be kind.", True), ("user", "", False), ("assistant", "Hello.", False)]


def test_vectors_are_made_again_between_checkpoints():
    draw = random.Random(1)
    codes = [draw.choice([3, 4, 5, 6, 7, 9, 10, 12, 13]) for _ in range(400)]
    (walk,) = dialogues.walked(codes, [1] * 400, dialogues.END, [0])
    whole = dialogues.END
    for code in reversed(codes):
        whole = dialogues.backward(code, 1, whole)
    walk.ended()
    assert walk.cost == whole[0] and len(walk.audit) >= 400
