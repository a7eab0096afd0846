"""Prefix trie and structure repair of conversations against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import harness
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import prefixtrie, repair
from corvane.runtime import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROLES = ["user", "assistant", "system", None, "", "tool", "usher"]
TEXTS = ["One.", "Two two", "Three!\n", None, "", " \t", "Why?  ", "no end", "é…"]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2], r[3])


def wild(seed, ids):
    draw = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([t, t, t, None, 2]), draw.choice(ROLES[: draw.randint(2, 7)]), draw.choice(TEXTS)))
    return rows + rows[:5]


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((c, t, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=order)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        built[c] = own.get(c - base, [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        kids = [x for x in under if len(x) == len(k) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), len(leaves), saved, SHA(ends)))
    return sorted(out, key=str)


def spark_trie(df):
    c = F.col("conv_id")
    return sorted(map(tuple, prefixtrie.trie(prefixtrie.turns(df, c - c % 20, (F.crc32(c.cast("string").cast("binary")) % 4).cast("int"), 3)).collect()), key=str)


@pytest.mark.parametrize("seed, ids", [(1, [*range(0, 45), None, -3, -20, -25]), (2, [*range(21, 40), 107, 118]), (3, [7])])
def test_trie_of_wild_rows(spark, seed, ids):
    rows = wild(seed, ids)
    assert spark_trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_trie_of_copies_across_families(spark):
    rows = [(c, t, "user", f"turn {t if c % 3 else t * 7}") for c in range(0, 200, 2) for t in range(1 + c % 6)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("mine").alias(x) for x in ("base", "at", "K1", "depth")))
    assert spark_trie(df) == plain_trie(rows)
    assert spark_trie(df.limit(0)) == []


def test_trie_query_as_sql(spark, con):
    assert harness.compare(spark, con, SF, prefixtrie.query, prefixtrie.ORACLE) == ""


def plain_repair(initials, faults):
    """Cost and audit by shortest (cost, audit) from each lattice node on, without a heuristic."""
    n = len(initials)
    heap, seen = [(0, "", 0, 0)], set()
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    while True:
        cost, audit, k, s = heapq.heappop(heap)
        if k == n and s in (0, 3):
            return cost, audit
        if (k, s, audit) in seen or len(audit) > 2 * n + 2:
            continue
        seen.add((k, s, audit))
        need = "a" if s == 2 else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", k, step[s][need]))
        if k < n:
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, s))
            if faults[k] != 1:
                stay = int(faults[k] == 2)
                heapq.heappush(heap, (cost + 2 + stay, audit + "R", k + 1, step[s][need]))
                if initials[k] in step[s]:
                    heapq.heappush(heap, (cost + stay, audit + "K", k + 1, step[s][initials[k]]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua x"), st.sampled_from([0, 0, 0, 1, 2])), max_size=6))
def test_search_against_all_audits(rows):
    initials, faults = "".join(r for r, _ in rows), bytes(f for _, f in rows)
    assert repair.cheapest(initials, faults) == plain_repair(initials, faults)


def table_repair(initials, faults):
    """Cost to go from the end, then the least edit that stays on a cheapest path: another method, for long rows."""
    n, far = len(initials), 10**9
    go = [[far] * 4 for _ in range(n + 1)]
    for k in range(n, -1, -1):
        for s in range(4) if k == n else ():
            go[k][s] = 0 if s in (0, 3) else far
        if k < n:
            for s in range(4):
                go[k][s] = min([p + go[k + 1][t] for e, p, d, t in edges(initials, faults, k, s) if d], default=far)
        for _ in range(4):
            for s in range(4):
                go[k][s] = min([go[k][s], *(p + go[k][t] for e, p, d, t in edges(initials, faults, k, s) if not d)])
    k, s, cost, audit = 0, 0, go[0][0], []
    while not (k == n and go[k][s] == 0):
        e, p, d, t = min(x for x in edges(initials, faults, k, s) if x[1] + go[k + x[2]][x[3]] == go[k][s])
        audit.append(e)
        k, s = k + d, t
    return cost, "".join(audit)


def edges(initials, faults, k, s):
    need = "a" if s == 2 else "u"
    to = {"s": 1, "u": 2, "a": 3}
    out = [("I", 2, 0, to[need])]
    if k < len(initials):
        out.append(("D", 3, 1, s))
        if faults[k] != 1:
            stay = int(faults[k] == 2)
            out.append(("R", 2 + stay, 1, to[need]))
            if initials[k] == need or initials[k] == "s" and s == 0:
                out.append(("K", stay, 1, to[initials[k]]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaa u"), st.sampled_from([0, 0, 0, 1, 2])), max_size=80))
def test_search_against_table(rows):
    initials, faults = "".join(r for r, _ in rows), bytes(f for _, f in rows)
    assert repair.cheapest(initials, faults) == table_repair(initials, faults)


def test_search_of_a_long_conversation():
    draw = random.Random(4)
    initials, faults = "".join(draw.choices("uas", k=20_000)), bytes(draw.choices([0, 0, 1, 2], k=20_000))
    assert repair.cheapest(initials, faults) == table_repair(initials, faults)


def plain_query(rows):
    out = []
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = []
        for _, t, r, x in own:
            r, x = (" " if r is None else r), (" " if x is None else x)
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            left += [] if k == 0 else [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
        left.sort(key=order)
        blank = duplicate = truncated = 0
        seen, faults = set(), []
        for _, _, r, x in left:
            words = WORD.findall(x)
            f = 1 if not words or (r, x) in seen else 2 if words[-1][-1] not in ".!?" else 0
            blank += not words
            duplicate += bool(words) and (r, x) in seen
            truncated += f == 2
            seen.add((r, x))
            faults.append(f)
        initials = "".join(r[:1] or " " for _, _, r, _ in left)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for _, t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = table_repair(initials, faults)
        lines, s, k = [], "", 0
        for e in audit:
            need = "assistant" if s == "u" else "user"
            role = need if e in "IR" else left[k][2]
            if e != "D":
                lines.append(f"{role}:{'' if e == 'I' else left[k][3]}")
                s = role[0]
            k += e != "I"
        out.append((c, gaps, blank, duplicate, truncated, illegal, cost, audit, SHA("\n".join(lines))))
    return sorted(out, key=str)


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.query(spark, SF).collect()), key=str) == plain_query(rows)


def test_repair_of_wild_rows(spark, tmp_path):
    rows = wild(9, [*range(60), None, -3]) + [(500, None, "user", "all null."), (501, None, None, None)]
    rows += [(600, t, "user", f"{t}?") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("mine").alias(x) for x in ("at", "audit", "Kind", "same")))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, repair.query(spark, str(tmp_path)).collect()), key=str) == plain_query(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.query(spark, f"{tmp_path}/none").collect() == []
