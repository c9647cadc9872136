"""Conversation repair: the cheapest edits by a dynamic program that keeps vectors at checkpoints only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fingerprint import digest_chunks
from tidemark.operators.running import Ordered
from tidemark.sources.shared import settle

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: What a repaired conversation has said so far: nothing, the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3, 4
#: The state after a turn that is put in or given another role, and whose turn that is.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States from which a turn of this role may be kept; it leads to the state of its name.
KEEPS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), OTHER: ()}
FINE, TRUNCATED, UNWANTED = 0, 1, 2
FAR = 1 << 60
#: Costs from each state after the last row: nothing if the conversation may end there.
END = (0, 2 * INSERT, INSERT, 0)
#: Rows in a block, which is the most that one call of a function here looks at.
ROWS = 1 << 16


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's.
    A null counts as one space, in the key as in role and text.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text, role = known("text"), known("role")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


@lru_cache(1 << 16)
def _before(state_of_row: tuple[int, int], costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a row, given those after it; those after it are closed under inserts."""
    letter, fault = state_of_row
    more = CUT_SHORT if fault == TRUNCATED else 0
    found = []
    for state in range(4):
        cost = min(costs[state] + DELETE, costs[NEXT[state]] + REROLE + more)
        if state in KEEPS[letter]:
            cost = min(cost, costs[letter] + more)
        found.append(cost)
    for _ in range(2):
        found = [min(found[state], found[NEXT[state]] + INSERT) for state in range(4)]
    return tuple(min(x, FAR) for x in found)


def backward(code: int, copies: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before ``copies`` equal rows; all but the first repeat it, and so have to go."""
    letter, fault = divmod(code, 3)
    gone = copies - (fault != UNWANTED)
    least = min(costs)
    shifted = tuple(min(x - least, FAR) for x in costs)
    if fault != UNWANTED:
        shifted = _before((letter, fault), shifted)
    return tuple(min(x + least + gone * DELETE, FAR) for x in shifted)


@dataclass
class Walk:
    """What a walk over rows has done: edits, and for each row who was put in before it and who speaks it."""

    state: int
    cost: int = 0

    def __post_init__(self):
        self.audit, self.before, self.roles, self.opens = [], [], [], []

    def ended(self) -> str:
        """Puts in what a conversation lacks at its end, and says who that is."""
        added = ""
        while END[self.state]:
            added += self.put_in()
        return added

    def put_in(self) -> str:
        self.state = NEXT[self.state]
        self.audit.append("I")
        self.cost += INSERT
        return ROLE[self.state][0]

    def row(self, code: int, copies: int, now: tuple[int, ...], later: tuple[int, ...]) -> None:
        """The ASCII-least tight edits of equal rows: of D, I, K and R the first that costs no more."""
        letter, fault = divmod(code, 3)
        more = CUT_SHORT if fault == TRUNCATED else 0
        gone = copies - (fault != UNWANTED)
        first, added, role = self.state == START, "", None
        later = tuple(x + gone * DELETE for x in later)
        while fault != UNWANTED:
            left = now[self.state]
            if later[self.state] + DELETE == left:
                self.audit.append("D")
                self.cost += DELETE
            elif now[NEXT[self.state]] + INSERT == left:
                added += self.put_in()
                continue
            elif self.state in KEEPS[letter] and later[letter] + more == left:
                self.audit.append("K")
                self.cost += more
                self.state, role = letter, ""
            else:
                self.audit.append("R")
                self.cost += REROLE + more
                self.state = NEXT[self.state]
                role = ROLE[self.state]
            break
        self.audit.append("D" * gone)
        self.cost += gone * DELETE
        self.before.append(added)
        self.roles.append(role)
        self.opens.append(first)


def walked(codes, copies, end: tuple[int, ...], starts: list[int]) -> list[Walk]:
    """The walks from some states over rows after which the costs are ``end``.

    Going back only every so manieth vector of costs is kept, the square root of the rows apart;
    going forward those between two are made again. So memory is that of the square root.
    """
    step = math.isqrt(len(codes)) + 1
    kept, costs = {len(codes): end}, end
    for i in range(len(codes) - 1, -1, -1):
        costs = backward(codes[i], copies[i], costs)
        if i % step == 0:
            kept[i] = costs
    walks = [Walk(state) for state in starts]
    for low in range(0, len(codes), step):
        high = min(low + step, len(codes))
        block = [kept[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(backward(codes[i], copies[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            for walk in walks:
                walk.row(codes[i], copies[i], block[i - low], block[i - low + 1])
    return walks


def _unit(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else FAR for s in range(4))


def _matrix(codes: pd.Series, copies: pd.Series) -> pd.Series:
    """Costs of a block of rows from each state to each."""

    def one(code, n):
        ways = []
        for end in range(4):
            costs = _unit(end)
            for i in range(len(code) - 1, -1, -1):
                costs = backward(code[i], n[i], costs)
            ways.append(costs)
        return [ways[end][start] for start in range(4) for end in range(4)]

    return pd.Series([one(c.tolist(), n.tolist()) for c, n in zip(codes, copies)])


def _leads_to(codes: pd.Series, copies: pd.Series, ends: pd.Series) -> pd.Series:
    """The state after a block from each state before it."""

    def one(code, n, end):
        return [w.state for w in walked(code.tolist(), n.tolist(), tuple(end.tolist()), list(range(4)))]

    return pd.Series([one(*x) for x in zip(codes, copies, ends)])


def _illegal(codes, copies) -> int:
    """Neighbours in a block whose roles may not follow each other."""
    letters = [code // 3 for code in codes]
    return sum(copies) - len(codes) + sum((a, b) not in ALLOWED for a, b in zip(letters, letters[1:]))


ALLOWED = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


EDITS = """audit string, cost long, illegal long, before array<string>, roles array<string>, opens array<boolean>,
    after string, after_opens boolean"""


def _edits(codes: pd.Series, copies: pd.Series, starts: pd.Series, ends: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = []
    for code, n, start, end, is_last in zip(codes, copies, starts, ends, last):
        code, n = code.tolist(), n.tolist()
        (walk,) = walked(code, n, tuple(end.tolist()), [start])
        nothing = walk.state == START
        after = walk.ended() if is_last else ""
        found.append(("".join(walk.audit), walk.cost, _illegal(code, n), walk.before, walk.roles, walk.opens, after, nothing))
    return pd.DataFrame(found, columns=["audit", "cost", "illegal", "before", "roles", "opens", "after", "after_opens"])


def _costs_after(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs after each block of one conversation, from the last block to the first."""
    pieces = pieces.sort_values("block", ascending=False)
    costs, found = END, []
    for way in pieces["way"]:
        found.append(list(costs))
        costs = tuple(min(min(way[4 * s + e] + costs[e] for e in range(4)), FAR) for s in range(4))
    return pd.DataFrame({"conv_id": pieces["conv_id"], "block": pieces["block"], "ends": found})


def _states_before(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of one conversation, from the first block on."""
    pieces = pieces.sort_values("block")
    state, found = START, []
    for leads in pieces["leads"]:
        found.append(state)
        state = int(leads[state])
    last = [False] * (len(found) - 1) + [True]
    return pieces[["conv_id", "block", "ends"]].assign(start=found, last=last)


def _met(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join on names in which nulls are equal; of the right only its other columns stay."""
    renamed = right.withColumnsRenamed({name: f"__{name}" for name in names})
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(renamed, same, how).drop(*(f"__{name}" for name in names))


ROW = ["conv_id", "turn", "role", "key"]


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number, ``code`` (role and first fault) and what of it counts.

    ``key`` is the hash of the text; texts themselves stay where they are.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    facts = rows.select(
        "conv_id",
        "turn",
        "role",
        F.sha2("text", 256).alias("key"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("short"),
    )
    groups = settle(facts.groupBy(*ROW).agg(F.count("*").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("short").alias("short")), "rows")
    first = groups.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select("conv_id", F.col("first.turn").alias("turn"), "role", "key", F.lit(True).alias("is_first"))
    told = _met(groups, first, ROW, "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    repeat = ~F.col("blank") & F.col("is_first").isNull()
    fault = F.when(F.col("blank") | repeat, UNWANTED).when(F.col("short"), TRUNCATED).otherwise(FINE)
    n = F.col("copies")
    return told.select(
        *ROW,
        "copies",
        (letter * 3 + fault).alias("code"),
        F.when(F.col("blank"), n).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).when(repeat, n).otherwise(n - 1).alias("duplicate"),
        F.when(fault == TRUNCATED, 1).otherwise(0).cast("long").alias("truncated"),
    )


@dataclass(frozen=True)
class Repair:
    """Equal rows of conversations in blocks, with the cheapest edits of each block."""

    rows: DataFrame
    groups: DataFrame
    pieces: DataFrame

    def lines(self) -> DataFrame:
        """``conv_id, place, opens, turn, role, text`` of the repaired conversations, in order of place.

        A turn put in has an empty text and no ``turn``. ``opens`` marks the first of a conversation.
        """
        at = F.col("block").cast("long") * (1 << 32)
        zipped = F.arrays_zip("rows", F.col("edits.before").alias("before"), F.col("edits.roles").alias("spoken"), F.col("edits.opens").alias("opens"))
        each = self.pieces.select("conv_id", "block", F.posexplode(zipped).alias("i", "x")).select(
            "conv_id", (at + F.col("i") * 8).alias("place"), "x.rows.*", "x.before", "x.spoken", "x.opens"
        )
        ends = self.pieces.select("conv_id", (at + F.size("rows") * 8).alias("place"), F.col("edits.after").alias("before"), F.col("edits.after_opens").alias("opens"))
        put_in = each.select("conv_id", "place", "before", "opens").unionByName(ends).filter("before <> ''")
        put_in = put_in.select("conv_id", "place", "opens", F.posexplode(F.split("before", "")).alias("i", "who")).select(
            "conv_id",
            (F.col("place") + F.col("i")).alias("place"),
            (F.col("opens") & (F.col("i") == 0)).alias("opens"),
            F.lit(None).cast(self.rows.schema["turn"].dataType).alias("turn"),
            F.when(F.col("who") == "u", "user").otherwise("assistant").alias("role"),
            F.lit("").alias("text"),
        )
        spoken = each.filter("spoken is not null")
        texts = self.rows.withColumn("key", F.sha2("text", 256)).groupBy(*ROW).agg(F.any_value("text").alias("text"))
        kept = _met(spoken, texts, ROW, "inner").select(
            "conv_id",
            (F.col("place") + 7).alias("place"),
            (F.col("opens") & (F.col("before") == "")).alias("opens"),
            "turn",
            F.when(F.col("spoken") == "", F.col("role")).otherwise(F.col("spoken")).alias("role"),
            "text",
        )
        return kept.unionByName(put_in)

    def report(self, ids: DataFrame) -> DataFrame:
        """One row for each of ``ids``: faults, illegal neighbours, cost, edits and the repaired text's hash."""
        turns = self.groups.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
            (F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
        )
        faults = self.groups.groupBy("conv_id").agg(*(F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")))
        letters = self.pieces.select(
            "conv_id", "block", "edits.audit", "edits.cost", "edits.illegal",
            F.expr("element_at(codes, 1) div 3").alias("opening"), F.expr("element_at(codes, -1) div 3").alias("closing"),
        )
        before = F.lag("closing").over(Window.partitionBy("conv_id").orderBy("block"))
        allowed = _any([(before == a) & (F.col("opening") == b) for a, b in sorted(ALLOWED)])
        meeting = F.when(before.isNotNull() & ~allowed, 1).otherwise(0)
        edits = letters.withColumn("meeting", meeting).groupBy("conv_id").agg(
            F.sum(F.col("illegal") + F.col("meeting")).alias("illegal"),
            F.sum("cost").alias("cost"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        )
        lines = self.lines()
        data = F.concat(F.when(F.col("opens"), "").otherwise("\n"), "role", F.lit(":"), "text")
        hashes = digest_chunks(lines.select(F.col("conv_id").alias("file_id"), F.col("place").alias("offset"), data.alias("data")))
        hashes = hashes.select(F.col("file_id").alias("conv_id"), F.col("hash").alias("repaired_sha256"))
        every = ids.select("conv_id").distinct()
        for part in (turns, faults, edits, hashes):
            every = every.unionByName(part, allowMissingColumns=True)
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return every.groupBy("conv_id").agg(
            *(F.coalesce(F.max(name).try_cast("long"), F.lit(0)).alias(name) for name in numbers),
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )


def _any(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for condition in conditions[1:]:
        whole = whole | condition
    return whole


def repair(rows: DataFrame, rows_per_block: int = ROWS) -> Repair:
    """The cheapest edits that make conversations take turns as ``(s?(ua)+)?`` by their roles' initials.

    Keeping a row costs nothing, another role 3, deleting 4, putting in an empty turn 3, and a
    truncated row that stays 3 more; blank rows and those whose role and text were seen earlier have
    to go. Of equally cheap edits the ASCII-least string wins. Rows are taken by ``turn``, nulls
    first, then by role and a hash of the text; equal rows are adjacent, all but one duplicates. A
    null ``conv_id`` is a conversation of its own, a null role or text is one space.

    A conversation of any length is cut into blocks. Costs from state to state are made in each,
    carried back over its blocks, then states forward, and only then edits; what is carried are two
    rows a block at most. In a block, vectors of costs are kept at checkpoints only. Texts move once
    to their kept rows and once more, in order, into the digest, which is sequential by nature.
    No rows give none, and clashing names of other columns don't matter.
    """
    blank = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    groups = settle(judged(rows), "judged")
    ordered = Ordered.cut(groups.select(*ROW, "copies", "code"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("key")], rows_per_block)
    row = F.struct("turn", "role", "key", "code", "copies")
    pieces = ordered.df.groupBy("conv_id", F.col("__block").alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pieces = settle(
        pieces.withColumns({"codes": F.transform("rows", lambda x: x["code"]), "copies": F.transform("rows", lambda x: x["copies"])}), "pieces"
    )
    split = ordered.split.withColumnRenamed("__s_conv_id", "split_id")
    longer = pieces.join(F.broadcast(split), F.col("conv_id").eqNullSafe(F.col("split_id")), "left_semi")
    kind = pieces.schema["conv_id"].dataType.simpleString()
    ways = longer.select("conv_id", "block", F.pandas_udf(_matrix, "array<bigint>")("codes", "copies").alias("way"))
    after = settle(ways.groupBy("conv_id").applyInPandas(_costs_after, f"conv_id {kind}, block int, ends array<bigint>"), "costs")
    leads = (
        _met(longer, F.broadcast(after), ["conv_id", "block"], "inner")
        .select("conv_id", "block", "ends", F.pandas_udf(_leads_to, "array<int>")("codes", "copies", "ends").alias("leads"))
        .groupBy("conv_id")
        .applyInPandas(_states_before, f"conv_id {kind}, block int, ends array<bigint>, start int, last boolean")
    )
    carried = settle(leads, "states")
    ends = F.coalesce("ends", F.array(*map(F.lit, END)).cast("array<bigint>"))
    started = _met(pieces, F.broadcast(carried), ["conv_id", "block"], "left")
    edits = F.pandas_udf(_edits, EDITS)("codes", "copies", F.coalesce("start", F.lit(START)), ends, F.coalesce("last", F.lit(True)))
    return Repair(rows, groups, settle(started.select("conv_id", "block", "rows", "codes", edits.alias("edits")), "edits"))


def repairs(conversations: DataFrame, rows_per_block: int = ROWS) -> DataFrame:
    """Damages conversations and reports on their repair, one row for every ``conv_id`` there was."""
    return repair(damaged(conversations), rows_per_block).report(conversations)
