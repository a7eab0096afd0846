"""Structure repair of conversations: cheapest edits by A* on the edit lattice.

A lattice node is (rows consumed, state of the role pattern ``(s?(ua)+)?``). Edges keep, rerole or delete the next row, or insert an
empty turn. The heuristic is the suffix sum of what the rows ahead cost in any case: three for each row that must be deleted, one for each truncated
row. It never exceeds the true cost and never falls by more than an edge costs, so the first goal that leaves the heap, keyed by cost
plus heuristic and then by the audit (the edits' initials), is cheapest and, of the cheapest, ASCII-least.

Audits are not copied: a heap entry is a leaf of the tree of audits, and two leaves are compared below their last common ancestor, found by jumps of
doubling length. The search reads two bytes a row; texts stay in Spark, and pass by once, in order, to be digested.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import materialise, ship, table

#: Costs of the edits, and what a truncated row adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant's turn.
START, SYSTEM, USER, DONE = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}
ROLE = {"u": "user", "a": "assistant"}
MUST, CHARGED = 1, 2
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Audit:
    """A list of edits as a leaf of the tree of all lists; the order is that of the strings of initials."""

    __slots__ = ("edit", "depth", "up", "jump")

    def __init__(self, edit: str, up: Audit | None):
        self.edit, self.up = edit, up
        self.depth = up.depth + 1 if up else 0
        far = up.jump if up else None
        self.jump = far.jump if far and up.depth - far.depth == far.depth - far.jump.depth else up or self

    def __lt__(self, other: Audit) -> bool:
        a, b = self, other
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= b.depth else a.up
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= a.depth else b.up
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.edit < b.edit

    def __str__(self) -> str:
        out, at = [], self
        while at.up:
            out.append(at.edit)
            at = at.up
        return "".join(reversed(out))


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the best edits of rows with these role initials (one letter each) and faults (MUST be deleted, or CHARGED if kept)."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] == MUST else TRUNCATED if faults[k] == CHARGED else 0)
    heap = [(ahead[0], Audit("", None), 0, START)]
    least: dict[tuple[int, int], int] = {}
    closed: set[tuple[int, int]] = set()
    while True:
        key, audit, row, state = heapq.heappop(heap)
        if row == n and state in (START, DONE):
            return key, str(audit)
        if (row, state) in closed:
            continue
        closed.add((row, state))
        cost = key - ahead[row]
        role = NEXT[state]
        edges = [("I", INSERT, row, STEP[state, role])]
        if row < n:
            edges.append(("D", DELETE, row + 1, state))
            if faults[row] != MUST:
                stay = TRUNCATED if faults[row] == CHARGED else 0
                edges.append(("R", REROLE + stay, row + 1, STEP[state, role]))
                if (state, initials[row]) in STEP:
                    edges.append(("K", stay, row + 1, STEP[state, initials[row]]))
        for edit, price, to, then in edges:
            total = cost + price + ahead[to]
            if (to, then) not in closed and total <= least.get((to, then), total):
                least[to, then] = total
                heapq.heappush(heap, (total, Audit(edit, audit), to, then))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn``; nulls of the key, of role and of text are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _faults(text: Column) -> Column:
    """MUST for a blank text, CHARGED for a truncated one, else 0."""
    bare = F.rtrim(F.translate(text, "\t\n\v\f\r", "     "))
    return F.when(bare == "", MUST).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CHARGED).otherwise(0).cast("int")


class Tally:
    """What one conversation's rows add up to; two bytes are kept of each row."""

    def __init__(self, conv: int | None):
        self.conv, self.initials, self.faults = conv, bytearray(), bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.turn = None

    def row(self, turn: int | None, initial: str, fault: int, repeated: bool) -> None:
        self.blank += fault == MUST
        self.duplicate += repeated and fault != MUST
        self.truncated += fault == CHARGED and not repeated
        letter = ord(initial) if initial in "sua" else ord(" ")
        self.illegal += bool(self.initials) and chr(self.initials[-1]) + chr(letter) not in ("su", "ua", "au")
        self.initials.append(letter)
        self.faults.append(MUST if repeated else fault)
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.distinct += 1

    def result(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.initials.decode(), bytes(self.faults)))


def searched(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, at, turn, initial, fault, repeated): counts of what is wrong, cost and audit."""

    def work(batches):
        now = None
        for b in batches:
            out = []
            for conv, *row in zip(*(b.column(c).to_pylist() for c in range(5))):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.result())
                    now = Tally(conv)
                now.row(*row)
            yield batch(out)
        if now:
            yield batch([now.result()])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if n == "audit" else pa.int64()) for k, n in enumerate(names)], names=names)

    names = ["conv_id", *COUNTS, "audit"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "turn", "initial", "fault", "repeated")
    return dealt.mapInArrow(work, f"{', '.join(f'{n} long' for n in names[:-1])}, audit string")


class Walk:
    """The rows of one conversation as its audit leaves them; each row that comes gives none, one or more."""

    def __init__(self, audit: str):
        self.audit, self.k, self.state = audit, 0, START

    def inserts(self):
        while self.audit[self.k : self.k + 1] == "I":
            self.k += 1
            role = NEXT[self.state]
            self.state = STEP[self.state, role]
            yield ROLE[role], ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.k]
        self.k += 1
        if edit != "D":
            initial = NEXT[self.state] if edit == "R" else role[0]
            yield (ROLE[initial] if edit == "R" else role), text
            self.state = STEP[self.state, initial]


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, role, text): the rows that are left of ``rows`` (conv_id, at, role, text), in order, the conversations one after the other.

    Each conversation's rows pass by behind its audit, a batch at a time.
    """

    def work(batches):
        conv, walk = None, None
        for b in batches:
            out = []
            for cid, audit, role, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                if audit is None:
                    out += [(cid, *x) for x in walk.row(role, text)]
                else:
                    if walk:
                        out += [(conv, *x) for x in walk.inserts()]
                    conv, walk = cid, Walk(audit)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
        if walk:
            out = [(conv, *x) for x in walk.inserts()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    names, kinds = ["conv_id", "role", "text"], [pa.int64(), pa.string(), pa.string()]
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "at", none.alias("audit"), "role", "text").union(audits.select("conv_id", F.lit(0), "audit", none, none))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "audit", "role", "text")
    return dealt.mapInArrow(work, "conv_id long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired`` gives: ``role:text`` of each row, newline-joined. It must come straight from there, as the order counts."""

    def work(batches):
        conv, sha = None, None
        for b in batches:
            out = []
            for cid, role, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                if sha and cid == conv:
                    sha.update(f"\n{role}:{text}".encode())
                else:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = cid, hashlib.sha256(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=names)

    names = ["conv_id", "repaired_sha256"]
    return rows.mapInArrow(work, "conv_id long, repaired_sha256 string")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at), written: ``at`` counts a conversation's rows by turn (null first), then role and text; null roles and texts are empty."""
    word = lambda c: F.coalesce(c, F.lit("")).alias(c)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role"), word("text"))
    return materialise(rows.withColumn("at", F.row_number().over(order)), "turns")


def audit(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation of ``numbered`` rows, and the cheapest edits; written.

    A null conv_id is a conversation like any other, and repeated rows are duplicates; no rows give none. Only a row's first fault counts:
    blank, duplicate (an earlier row has its role and text), truncated.
    """
    ship(rows.sparkSession)
    same = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))
    initial = F.rpad(F.substring("role", 1, 1), 1, " ")
    narrow = rows.select("conv_id", "at", "turn", initial.alias("initial"), _faults(F.col("text")).alias("fault"), same.alias("same"))
    repeated = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("at")) > 1
    return materialise(searched(narrow.withColumn("repeated", repeated)), "audits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conv_id of ``conversations`` (null is one, too), whose rows are damaged, searched and repaired; other columns are not read."""
    conversations = table(spark, sf_dir, "conversations")
    rows = numbered(damaged(conversations))
    audits = audit(rows)
    parts = {"a": audits, "d": digests(repaired(rows, audits))}
    out = conversations.select("conv_id").distinct().alias("c")
    for name, part in parts.items():
        out = out.join(part.alias(name), F.col("c.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
