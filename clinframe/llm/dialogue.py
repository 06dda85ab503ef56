"""Faults of conversations, and the cheapest edits that repair them.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turn. Edits are Keep (0), Rerole to user or assistant (2), Delete
(3; the only edit of a blank or repeated turn) and Insert of an empty user or assistant turn (2);
a truncated turn that stays costs 1 more. The answer is the least (cost, audit), the audit being
the edits' initials in order.

The search is a depth-first branch-and-bound over nodes (turns done, state). Its stack is explicit;
the cheapest child is met first. A suffix bound charges every turn its least edit and every
disjoint pair of neighbours with the same role the edit that must part them. A prefix goes when
bound and incumbent (cost, audit) exclude it, or when its node was reached by a prefix that is not
worse: two prefixes of one node with equal cost differ before the shorter one ends (the longer
would hold more inserts and cost more), so what follows cannot reverse their order. The stack runs
empty only when the incumbent is proved best.

Long conversations are searched in stretches of ``STRETCH`` turns, each for all pairs of states at
its ends, and chained by (cost, audit); for the same reason that is exact. Conversations beyond
``HOT_TURNS`` turns are also cut into slices that other tasks search, and only the slices' results
are chained. Just the checksum of the repaired conversation, which cannot be split, is made by one
task that reads its turns as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from clinframe.llm.common import shuffle_tasks
from clinframe.operators.skew import SLICE, null_safe_join, ordered_slices
from clinframe.session import stored

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Bytes that do not count as text, and those that end a whole turn.
SPACE, ENDS = b" \t\n\x0b\x0c\r", b".!?"
#: Turns searched at once: beyond, prefixes are improved too often.
STRETCH = 24
#: Sequences of short conversations whose repair a task remembers.
REMEMBERED = 50_000
#: Turns of a conversation that one task holds.
HOT_TURNS = 20_000
#: Rows of one Arrow batch, and bytes of text after which it leaves earlier.
BATCH, BATCH_BYTES = 4096, 8_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with this initial, by the state before it.
NEXT = {b"s": {START: SYSTEM}, b"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
#: The role that a rerole or an insert gives in each state, and the state after it.
GIVEN = {START: (b"user", USER), SYSTEM: (b"user", USER), USER: (b"assistant", ASSISTANT), ASSISTANT: (b"user", USER)}
PAIRS = {b"su", b"ua", b"au"}

#: A turn as the search sees it: must go, truncated, initial, repeats of it that must go too.
Code = tuple[bool, bool, bytes, int]
Best = dict[tuple[int, int], tuple[int, str]]


def suffix_bounds(codes: list[Code]) -> tuple[list[int], list[int]]:
    """Least cost of the turns from each on: while a system turn may still stay, and after."""
    n = len(codes)
    own, pair, system = [0] * (n + 2), [0] * (n + 2), [False] * (n + 2)
    for i in range(n - 1, -1, -1):
        gone, cut, initial, repeats = codes[i]
        cost = DELETE if gone else cut * TRUNCATED + (0 if initial in (b"u", b"a") else REROLE)
        own[i] = own[i + 1] + cost + repeats * DELETE
        system[i] = system[i + 1] or (initial == b"s" and not gone)
        pair[i] = pair[i + 1]
        if i + 1 < n and not gone and not codes[i + 1][0] and initial == codes[i + 1][2] and initial in (b"u", b"a"):
            pair[i] = max(pair[i], pair[i + 2] + REROLE)
    later = [own[i] + pair[i] for i in range(n + 1)]
    return [later[i] - REROLE * system[i] for i in range(n + 1)], later


def search(codes: list[Code], entry: int, goals: set[int]) -> tuple[int, str] | None:
    """Least (cost, audit) from ``entry`` to one of ``goals``, or None where no edits lead there."""
    early, later = suffix_bounds(codes)
    n, best = len(codes), None
    reached = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] != (cost, audit):
            continue
        if best and (cost + (later if state else early)[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        role, after = GIVEN[state]
        moves = [(i, after, INSERT, "I")]
        if i < n:
            gone, cut, initial, repeats = codes[i]
            rest, tail = repeats * DELETE, "D" * repeats
            moves.append((i + 1, state, DELETE + rest, "D" + tail))
            if not gone:
                stays = cut * TRUNCATED + rest
                moves.append((i + 1, after, REROLE + stays, "R" + tail))
                if state in NEXT.get(initial, ()):
                    moves.append((i + 1, NEXT[initial][state], stays, "K" + tail))
        children = []
        for at, to, price, letters in moves:
            found = (cost + price, audit + letters)
            bound = found[0] + (later if to else early)[at]
            if best and bound > best[0]:
                continue
            known = reached.get((at, to))
            if known is None or found < known:
                reached[at, to] = found
                children.append((bound, letters, (at, to, *found)))
        children.sort(reverse=True)
        stack.extend(child[2] for child in children)
    return best


def chain(best: Best, more: Best) -> Best:
    """Both stretches, one after the other."""
    out: Best = {}
    for (a, b), (cost, audit) in best.items():
        for (c, d), (price, letters) in more.items():
            if b == c:
                found = (cost + price, audit + letters)
                if (a, d) not in out or found < out[a, d]:
                    out[a, d] = found
    return out


def search_all(codes: list[Code], entries: Iterable[int]) -> Best:
    """The best of every pair of states around ``codes`` that starts in one of ``entries``."""
    best: Best = {(e, e): (0, "") for e in entries}
    for at in range(0, len(codes), STRETCH):
        part = codes[at : at + STRETCH]
        more: Best = {}
        for entry in {b for _, b in best}:
            for goal in (START, SYSTEM, USER, ASSISTANT):
                found = search(part, entry, {goal})
                if found:
                    more[entry, goal] = found
        best = chain(best, more)
    return best


@lru_cache(REMEMBERED)
def _short(codes: tuple[Code, ...]) -> tuple[int, str]:
    return search(list(codes), START, {START, ASSISTANT})


def repair_codes(codes: list[Code]) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    if len(codes) <= STRETCH:
        return _short(tuple(codes))
    best = search_all(codes, [START])
    return min(best[e] for e in ((START, START), (START, ASSISTANT)) if e in best)


def apply(turns: Iterable[tuple[bytes, bytes]], audit: str, state: int = START) -> Iterator[tuple[bytes, bytes]]:
    """The turns that an audit leaves, from the ``state`` before the first on."""
    turns = iter(turns)
    for letter in audit:
        if letter == "I":
            role, text = GIVEN[state][0], b""
        else:
            role, text = next(turns)
            if letter == "D":
                continue
            if letter == "R":
                role = GIVEN[state][0]
        state = NEXT[role[:1]][state]
        yield role, text


class Faults:
    """Counts the faults of a conversation's turns and codes them for the search."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.codes: list[Code] = []
        self.last: bytes | None = None
        self.first: bytes | None = None

    def add(self, role: bytes, text: bytes, seen: bool, repeats: int = 0) -> None:
        content = text.rstrip(SPACE)
        blank = not content
        cut = not blank and not seen and content[-1] not in ENDS
        self.blank += (1 + repeats) * blank
        self.duplicate += (not blank) * (seen + repeats)
        self.truncated += cut
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in PAIRS
        self.illegal += repeats
        self.last = initial
        self.codes.append((blank or seen, cut, initial, repeats))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches that stay small when their texts are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= BATCH or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _fields(*fields: str) -> list[StructField]:
    return list(StructType.fromDDL(", ".join(fields)).fields)


def _run(df: DataFrame, step, fields: list[StructField]) -> DataFrame:
    """``step`` over the rows of each task, as an iterator of tuples to an iterator of tuples."""
    out = StructType(fields)
    schema = to_arrow_schema(out)
    return df.mapInArrow(lambda batches: _batches(step(_rows(batches)), schema), out)


SUMMARY = (
    "gaps bigint",
    "blank bigint",
    "duplicate bigint",
    "truncated bigint",
    "illegal bigint",
    "cost bigint",
    "audit string",
    "repaired_sha256 string",
)


def _whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conversation, turn, role, text, there) in order: one summary per conversation."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        faults, seen, turns, days = Faults(), set(), [], set()
        for _, turn, role, text, there in group:
            if there:
                faults.add(role, text, (role, text) in seen)
                seen.add((role, text))
                turns.append((role, text))
                if turn is not None:
                    days.add(turn)
        cost, audit = repair_codes(faults.codes)
        text = b"\n".join(role + b":" + text for role, text in apply(turns, audit))
        gaps = max(days) - min(days) + 1 - len(days) if days else 0
        counts = (faults.blank, faults.duplicate, faults.truncated, faults.illegal)
        yield conv, gaps, *counts, cost, audit, hashlib.sha256(text).hexdigest()


def _slices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conversation, slice, turn, role, text, copies, first) in order: for each slice its
    faults and one row per pair of states."""
    for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
        faults = Faults()
        for _, _, _, role, text, copies, first in group:
            faults.add(role, text, not first, copies - 1)
        best = search_all(faults.codes, range(4))
        counts = (faults.blank, faults.duplicate, faults.truncated, faults.illegal)
        for (entry, goal), (cost, audit) in sorted(best.items()):
            yield conv, part, entry, goal, cost, audit, *counts, faults.first, faults.last


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The slices of each conversation in order: each with the state before it, its part of the
    audit, its cost and its faults. Holds the parts of one conversation's audits."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        best: dict[int, tuple[int, str]] = {START: (0, "")}
        paths: list[dict[int, tuple[int, int, str]]] = []
        parts, last = [], None
        for part, same in groupby(group, key=lambda r: r[1]):
            options = list(same)
            now: dict[int, tuple[int, str]] = {}
            path: dict[int, tuple[int, int, str]] = {}
            for _, _, entry, goal, cost, audit, *_ in options:
                if entry in best:
                    found = (best[entry][0] + cost, best[entry][1] + audit)
                    if goal not in now or found < now[goal]:
                        now[goal], path[goal] = found, (entry, cost, audit)
            blank, duplicate, truncated, illegal, first, end = options[0][6:]
            if last is not None:
                illegal += last + first not in PAIRS
            last, best = end, now
            paths.append(path)
            parts.append((part, blank, duplicate, truncated, illegal))
        state = min((best[g], g) for g in (START, ASSISTANT) if g in best)[1]
        out = []
        for (part, *counts), path in zip(reversed(parts), reversed(paths), strict=True):
            state, cost, audit = path[state]
            out.append((conv, part, state, audit, cost, *counts))
        yield from reversed(out)


def _applied(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conversation, slice, text row, turn, role, text, copies, state) in order, the slice's
    audit being the text of its first row: the turns that stay, numbered in their slice."""
    for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
        _, _, is_turn, _, _, audit, _, state = next(group)
        if is_turn:
            raise ValueError("a conversation has turns and no audit")
        turns = ((role, text) for _, _, _, _, role, text, copies, _ in group for _ in range(copies))
        for place, (role, text) in enumerate(apply(turns, audit.decode(), state)):
            yield conv, part, place, role, text


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, group in groupby(rows, key=lambda r: r[0]):
        digest, between = hashlib.sha256(), b""
        for _, _, _, role, text in group:
            digest.update(between + role + b":" + text)
            between = b"\n"
        yield conv, digest.hexdigest()


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str, there: Column) -> DataFrame:
    """The columns in use, under names that no further column can clash with."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).cast("binary")
    return rows.select(
        F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("t"), given(role).alias("r"), given(text).alias("x"), there.alias("there")
    )


def _sliced(turns: DataFrame, hot_turns: int) -> DataFrame:
    """Turns of long conversations: equal rows joined (copies), cut into slices, the first of equal
    role and text marked."""
    same = turns.where("there").groupBy("c", "t", "r", "x").agg(F.count(F.lit(1)).alias("copies"))
    same = same.withColumns({"_r": F.hex("r"), "_x": F.substring(F.hex("x"), 1, 64)})
    cut, _ = ordered_slices(same, ["c"], [("t", "asc"), ("_r", "asc"), ("_x", "asc")], hot_turns)
    place = F.struct(F.col("t").isNotNull().alias("some"), "t")
    first = same.groupBy("c", "r", "x").agg(F.min(place).alias("place"))
    first = first.select("c", F.col("place.t").alias("t"), "r", "x", F.lit(True).alias("first"))
    found = null_safe_join(cut, first, ["c", "t", "r", "x"], "left")
    return found.select("c", SLICE, "t", "r", "x", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def _repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows (c, slice, place, r, x) of repaired slices; ``turns`` has copies, ``audits`` (c, slice,
    entry, audit)."""
    spark, key = turns.sparkSession, turns.schema["c"]
    none = F.lit(None)
    both = turns.select("c", SLICE, F.lit(True).alias("is_turn"), "t", "r", "x", "copies", none.cast("int").alias("state"))
    both = both.unionByName(
        audits.select(
            "c", SLICE, F.lit(False).alias("is_turn"), none.cast("bigint").alias("t"), none.cast("binary").alias("r"),
            F.col("audit").cast("binary").alias("x"), F.lit(0).cast("bigint").alias("copies"), F.col("entry").alias("state"),
        )
    )
    dealt = both.repartition(shuffle_tasks(spark), "c", SLICE).sortWithinPartitions("c", SLICE, "is_turn", "t", "r", "x")
    return _run(dealt, _applied, [key, *_fields(f"{SLICE} bigint", "place bigint", "r binary", "x binary")])


def _long(turns: DataFrame, hot_turns: int) -> DataFrame:
    """Summaries of long conversations, from their slices."""
    spark, key = turns.sparkSession, turns.schema["c"]
    tasks = shuffle_tasks(spark)
    cut = stored(_sliced(turns, hot_turns))
    dealt = cut.repartition(tasks, "c", SLICE).sortWithinPartitions("c", SLICE, "t", "r", "x")
    counts = ("blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint")
    searched = _run(
        dealt, _slices, [key, *_fields(f"{SLICE} bigint", "entry int", "goal int", "cost bigint", "audit string", *counts, "first binary", "last binary")]
    )
    dealt = searched.repartition(tasks, "c").sortWithinPartitions("c", SLICE, "entry", "goal")
    audits = stored(_run(dealt, _chained, [key, *_fields(f"{SLICE} bigint", "entry int", "audit string", "cost bigint", *counts)]))
    parts = F.array_sort(F.collect_list(F.struct(SLICE, "audit")))
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    summary = audits.groupBy("c").agg(*sums, F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    days = turns.where("there").select("c", "t").distinct().groupBy("c").agg((F.max("t") - F.min("t") + 1 - F.count("t")).alias("gaps"))
    kept = _repaired(cut, audits).repartition(tasks, "c").sortWithinPartitions("c", SLICE, "place")
    digests = _run(kept, _digests, [key, *_fields("repaired_sha256 string")])
    every = null_safe_join(null_safe_join(turns.select("c").distinct(), summary, ["c"], "left"), days, ["c"], "left")
    every = null_safe_join(every, digests, ["c"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return every.select(
        "c", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def _hot(turns: DataFrame, hot_turns: int) -> DataFrame | None:
    """The conversations beyond ``hot_turns`` turns (fewer than rows / hot_turns), or None."""
    found = stored(turns.groupBy("c").count().where(F.col("count") > hot_turns).select("c"))
    return None if found.isEmpty() else found


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    there: Column | None = None,
    hot_turns: int = HOT_TURNS,
) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, cost and audit of the best repair, and
    the checksum of the repaired turns (``role:text``, joined by line feeds).

    Turns are taken by number, null ones first, then role and text. Of a turn's faults the first
    counts: blank, duplicate (role and text seen earlier), truncated. Null roles and texts read as
    one blank, and a null conversation is one of its own. An empty role fits no place. Rows where
    ``there`` is false only name their conversation; one without turns has zeros, an empty audit
    and the checksum of nothing. Further columns are not read; an empty table gives no rows.
    """
    turns = _named(rows, conv, turn, role, text, F.lit(True) if there is None else there)
    spark, hot = rows.sparkSession, _hot(turns, hot_turns)
    short = turns if hot is None else null_safe_join(turns, hot, ["c"], "left_anti")
    dealt = short.repartition(shuffle_tasks(spark), "c").sortWithinPartitions("c", "t", "r", "x")
    out = _run(dealt, _whole, [turns.schema["c"], *_fields(*SUMMARY)])
    if hot is not None:
        out = out.unionByName(_long(null_safe_join(turns, hot, ["c"], "left_semi"), hot_turns))
    return out.withColumnRenamed("c", conv)


def repaired_turns(
    rows: DataFrame,
    found: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    there: Column | None = None,
) -> DataFrame:
    """The repaired turns (conversation, place, role, text) that the audits of ``found``, a result
    of ``repair`` on the same rows, lead to. A task streams the turns of a conversation."""
    turns = _named(rows, conv, turn, role, text, F.lit(True) if there is None else there).where("there")
    whole = turns.select("c", F.lit(0).cast("bigint").alias(SLICE), "t", "r", "x", F.lit(1).cast("bigint").alias("copies"))
    audits = found.select(F.col(conv).alias("c"), F.lit(0).cast("bigint").alias(SLICE), F.lit(START).alias("entry"), "audit")
    out = _repaired(whole, audits)
    return out.select(F.col("c").alias(conv), "place", F.col("r").cast("string").alias(role), F.col("x").cast("string").alias(text))
