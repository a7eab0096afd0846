"""Near-duplicate stage: documents whose five-word shingles overlap by 0.8 or more, by SimHash fingerprints and exact overlap.

A SimHash fingerprint of 256 bits is kept for each distinct text. Candidates meet under anchors, the least
shingle hash under each of several orders, which two texts of similarity s share with probability s each, within
classes of size: a text is filed under its own class and also calls at the next one. In
blocks of bounded size their Hamming distances to reference fingerprints are compared, pairs whose tables differ by more than the
limit in any coordinate are discarded, and survivors are verified by their bits. Texts so connected form groups; only their shingles
are made again, moved to their group, and compared exactly. A block gives back a spanning set of links, never its pairs.

Rows of one key first meet in small chunks, each with the same pivot row of the key, so that a large group of near copies is linked
in work proportional to its rows. Only rows that this leaves apart from the pivot meet all others of the key, block against block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.llm.graph import components
from corvane.runtime import discard, materialise, ship

WIDTH, LEAST, ANCHORS, WORDS64, REFERENCES, CHUNK, BLOCK, BLOCK_BYTES = 5, 0.8, 8, 4, 16, 128, 1024, 64 << 20
#: Chunks whose rows carry their shingles are so many times smaller, as are their tasks.
HEAVY = 4
#: Sides of rows in a block: a key's pivot; rows apart from it against rows that are linked to it.
PIVOT, APART, REST = -3, -2, -1
#: Differing bits at most, for sets of FEW shingles or more, and for smaller ones, whose bits vary more.
LIMIT, LIMIT_FEW, FEW = 72, 104, 64
#: Members of groups are told to all tasks below this size, by a join beyond it.
BROADCAST_BYTES = 64 << 20
_ODD = np.array([xxhash.xxh64_intdigest(f"order {k}", 3) | 1 for k in range(max(ANCHORS, WORDS64))], np.uint64)
_REFS = np.array([[xxhash.xxh64_intdigest(f"reference {k}.{j}", 7) for j in range(WORDS64)] for k in range(REFERENCES)], np.uint64)
_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (fewer words: all of them); a text without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < WIDTH else map(b" ".join, zip(*(w[k:] for k in range(WIDTH))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(32))) * _ODD[k]
        return x ^ (x >> np.uint64(29))


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """Fingerprint of WORDS64 words and the anchors."""
    marks, votes = [], []
    for k in range(max(ANCHORS, WORDS64)):
        x = _spread(h, k)
        if k < ANCHORS:
            marks.append(int(x.min() ^ np.uint64(k)))
        if k < WORDS64:
            at = x.astype("<u8").view(np.uint8).reshape(len(x), 8) + np.arange(8) * 256
            votes.append(2 * (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel() > len(x))
    return np.packbits(np.concatenate(votes), bitorder="little").tobytes(), marks


def _sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, same, n, fp, anchors) for each row: a number of its own, and what its shingles give."""

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                fp, marks = sketch(h) if len(h) else (b"", [])
                rows.append((at, xxhash.xxh3_128_digest(h.tobytes()), len(h), fp, [m - (1 << 64) if m >> 63 else m for m in marks]))
                at += 1
            cols = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([arrays[0], b.column(0), b.column(1), *arrays[1:]], names=["row", "doc_id", "text_hash", "same", "n", "fp", "anchors"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return picked.mapInArrow(run, "row long, doc_id long, text_hash long, same binary, n long, fp binary, anchors array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    c = np.concatenate((a, b))
    c.sort(kind="stable")  # two runs, which are merged
    both = int(np.count_nonzero(c[1:] == c[:-1]))
    return both / (len(c) - both) if both else 0.0


def _root(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each row's least linked row) after the links (i, j)."""
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(root, at, least)
        root = root[root]
        if (root == before).all():
            return root


def near_bits(fp: np.ndarray, pivots: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) the sizes, the pivot tables and the bits leave."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    limit = np.where(small < FEW, LIMIT_FEW, LIMIT)
    ok = small >= LEAST * large
    ok[ok] = np.abs(pivots[i[ok]] - pivots[j[ok]]).max(1, initial=0) <= limit[ok]
    ok[ok] = np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]).sum(1) <= limit[ok]
    return ok


def _pairs_of(group: np.ndarray, side: np.ndarray, home: np.ndarray, within: np.ndarray, fp: np.ndarray, size: np.ndarray):
    """Surviving pairs (i, j), as two arrays, of rows that lie in one group, whose rows follow one another, a bounded number at once."""
    pivots = np.bitwise_count(fp[:, None, :] ^ _REFS[None]).sum(2).astype(np.int16)
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(group)) - 1  # rows of the group after each
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(after[lo:]), 1_000_000)) + lo)
        i = np.repeat(np.arange(lo, hi), after[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
        ok = (home[i] | home[j]) & (within[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = near_bits(fp, pivots, size, i, j)
        yield i[ok], j[ok]
        lo = hi


def _work(exact: bool):
    """Links (u, v) that span what is linked in each group of rows with equal (key, a, b), which follow one another, and rows (u, u, key, apart)
    that are not linked with the group's pivot, if it has one.

    Columns: key, a, b, rep, own, home, n, fp and, if ``exact``, grams. A group has 2 x BLOCK rows or so at most.
    """

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                held = yield from told(held, False)
                rows = sum(b.num_rows for b in held)
        yield from told(held, True)

    def told(held, last):
        if not held:
            return []
        t = pa.Table.from_batches(held).combine_chunks()
        key, a, b = (t.column(k).to_numpy() for k in range(3))
        new = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        group, n = np.cumsum(new), t.num_rows
        if not last:  # the last group may go on
            n = int(np.flatnonzero(new)[-1])
        if n:
            ids, own, home, size = (t.column(k).to_numpy()[:n] for k in (3, 4, 5, 6))
            fp = np.frombuffer(b"".join(t.column(7)[:n].to_pylist()), np.uint64).reshape(n, WORDS64)
            sets = [np.frombuffer(g, np.uint64) for g in t.column(8)[:n].to_pylist()] if exact else None
            root = np.arange(n)
            for i, j in _pairs_of(group[:n], own, home.astype(bool), (a == b)[:n], fp, size):
                if not exact:
                    root = _joined(root, i, j)
                    continue
                for lo in range(0, len(i), 4096):
                    root = _joined(root, np.zeros(0, np.int64), np.zeros(0, np.int64))
                    apart = np.flatnonzero(root[i[lo : lo + 4096]] != root[j[lo : lo + 4096]]) + lo
                    for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                        u, v = _root(root, x), _root(root, y)
                        if u != v and overlap(sets[x], sets[y]) >= LEAST:
                            root[max(u, v)] = min(u, v)
            root = _joined(root, np.zeros(0, np.int64), np.zeros(0, np.int64))
            pivot = np.full(group[n - 1] + 1, -1)
            pivot[group[:n][own == PIVOT]] = np.flatnonzero(own == PIVOT)
            pivot = pivot[group[:n]]
            apart = (pivot >= 0) & (root != root[pivot])
            rest = np.flatnonzero(apart | (root != np.arange(n)))
            cols = [pa.array(x[rest], pa.int64()) for x in (ids, ids[root], key[:n])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(apart[rest])], names=["u", "v", "key", "apart"])
        return t.slice(n).to_batches() if n < t.num_rows else []

    return run


def _parts(rows: Column, limit: int) -> Column:
    """In how many parts ``rows`` of a key's ``size`` rows are dealt, such that each has ``limit`` rows, or BLOCK_BYTES, at most or so."""
    share = F.col("bytes") * (rows / F.col("size")) / BLOCK_BYTES
    return F.greatest(F.lit(1), F.ceil(F.greatest(rows / limit, share)).cast("int"))


def _links(met: DataFrame, exact: bool, chunk: int, block: int, name: str, again=None) -> DataFrame:
    """Links (u, v) that span what is linked among the rows ``met`` (key, size, bytes, pivot, rep, home, n, fp, ...) of each key.

    ``again`` gives the rows of some keys a second time, from a frame of these keys (else they are looked up in ``met``)."""
    payload = ["rep", "own", "home", "n", "fp"] + ["grams"] * exact

    def worked(dealt: DataFrame, to: str) -> DataFrame:
        sorted_rows = dealt.select("key", "a", "b", *payload).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        return materialise(sorted_rows.mapInArrow(_work(exact), "u long, v long, key long, apart boolean"), to)

    parts, is_pivot = F.col("parts"), F.col("rep") == F.col("pivot")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    dealt = met.withColumn("parts", _parts(F.col("size"), chunk))
    dealt = dealt.withColumn("b", F.explode(F.when(is_pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)))).withColumn("a", F.col("b"))
    first = worked(dealt.withColumn("own", F.when(is_pivot & (parts > 1), PIVOT).otherwise(0)), name)
    apart = first.where("apart").select("key", F.col("u").alias("rep"), "apart")
    if apart.isEmpty():
        return first.select("u", "v")
    keys = apart.groupBy("key").agg(F.count("*").alias("n_apart"))
    rows = (again(keys.select("key")) if again else met).join(keys, "key").join(apart, ["key", "rep"], "left")
    rows = rows.withColumn("us", _parts(F.col("n_apart"), block)).withColumn("them", _parts(F.col("size") - F.col("n_apart"), block))
    # Rows apart meet each other in blocks a <= b, and the rest in blocks with a < 0, which are of two sides.
    at = F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("apart"), F.col("us")).otherwise(F.col("them"))).cast("int")
    place = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("own"))
    others = F.transform(F.sequence(F.lit(0), F.col("us") - 1), lambda x: place(F.least(F.col("at"), x), F.greatest(F.col("at"), x), F.col("at")))
    against = F.transform(F.sequence(F.lit(0), F.col("them") - 1), lambda y: place(-1 - F.col("at"), y, F.lit(APART)))
    rest = F.transform(F.sequence(F.lit(0), F.col("us") - 1), lambda x: place(-1 - x, F.col("at"), F.lit(REST)))
    placed = rows.withColumn("at", at).withColumn("place", F.explode(F.when(F.col("apart"), F.concat(others, against)).otherwise(rest)))
    second = worked(placed.select("key", "place.a", "place.b", "place.own", *(c for c in payload if c != "own")), f"{name}-apart")
    return first.select("u", "v").union(second.select("u", "v"))


def _shingles_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(text_hash, same, grams) of the rows of ``docs`` whose text's hash is that of one of ``members`` (text_hash)."""

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["text_hash", "same", "grams"])

    small = members.count() * 16 <= BROADCAST_BYTES
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    some = texts.join(F.broadcast(members) if small else members, "text_hash", "left_semi")
    return some.mapInArrow(run, "text_hash long, same binary, grams binary")


def near_duplicates(docs: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, component_id, kept) for each row: the smallest id among rows linked, directly or through others.

    Texts link whose shingle sets are equal or overlap by 0.8 or more; texts without words link with each other. Anchors
    miss a pair at 0.8 with probability under 0.00001. text_hash is xxhash64 of the text. Rows of one id with different texts are told
    apart. A null id never names a component (null if no row of it has an id); repeated rows stay. kept is true for the rows of one text of each component: of the
    smallest id, and of the smallest hash if that has several texts. An empty table gives no rows; other columns may have any names.
    """
    ship(docs.sparkSession)
    rows = materialise(_sketches(docs), "sketches")
    classes = materialise(rows.groupBy("same").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n", "fp", "anchors", "text_hash"), "row").alias("x")).select("same", "rep", "copies", "x.*"), "classes")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / LEAST)) + 1e-9)
    each = classes.where("n > 0").select("rep", "n", "fp", size_class.alias("size_class"), F.explode("anchors").alias("anchor"))
    each = each.select("rep", "n", "fp", "size_class", "anchor", F.explode(F.array(F.lit(0), F.lit(1))).alias("call"))
    each = each.select("rep", "n", "fp", F.xxhash64("anchor", F.col("size_class") + F.col("call")).alias("key"), (F.col("call") == 0).alias("home"))
    full = each.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("home"), F.col("rep"))).alias("pivot")).where("size > 1 and pivot is not null")
    near = _links(each.join(full, "key").withColumn("bytes", F.col("size") * 32), False, chunk, block, "near-bits")
    groups = materialise(components(near).select(F.col("u").alias("rep"), F.col("component").alias("key")), "groups")
    members = materialise(classes.join(groups, "rep").select("same", "text_hash", "rep", "key", "n", "fp"), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"))

    def with_shingles(some: DataFrame) -> DataFrame:
        grams = _shingles_of(docs, some.select("text_hash").distinct()).groupBy("same").agg(F.first("grams").alias("grams"))
        return some.join(sizes, "key").withColumns({"home": F.lit(True), "pivot": F.col("key")}).join(grams, "same")

    links = _links(with_shingles(members), True, max(1, chunk // HEAVY), block, "text-links", lambda keys: with_shingles(members.join(keys, "key", "left_semi")))
    comp = components(links)
    root = materialise(classes.select("same", "rep", "copies").join(comp.withColumnRenamed("u", "rep"), "rep", "left").select("same", "copies", F.coalesce("component", "rep").alias("component")), "roots")
    total = rows.count()
    named = materialise(hot.join(rows.select("doc_id", "text_hash", "same"), root, "same", "copies", total).select("doc_id", "text_hash", "component"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    firsts = named.groupBy("component").agg(first, F.count("*").alias("m")).select("component", "first.doc_id", "first.text_hash", "m").toDF("component", "component_id", "first_hash", "m")
    out = hot.join(named, materialise(firsts, "firsts"), "component", "m", total)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    discard(members)
    return out.select("doc_id", "text_hash", "component_id", kept.alias("kept"))
