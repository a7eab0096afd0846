"""Language-model scoring by online logistic context mixing.

Text is lower-cased (A-Z) and cut into words; one end closes the text. A word is a path of yes-no decisions in
a Huffman tree whose leaves are the common words and, for all others, buckets by their last two bytes. Each decision is predicted by its own
frequency and from three hashed contexts that reach over the words before it (the last very common word, the word before, the two words
before), with the row's own count left out of what training rows see. A logistic mixer joins the predictions with weights chosen by a gate of how much
the contexts have seen; along each text it predicts, then learns, online, what this text adds to the weights of all; an adaptive probability
map refines the result. Weights and map come from two halves of the training rows, each predicted without its own counts. Within a bucket a
word has its share of the training counts.

Contexts of many words are phrases: texts are cut where a hash of two neighbouring words says so, 12 words apart on the mean.
A phrase's probability mixes the product over its words with its frequency among all phrases of the training corpus.

What grows with the corpus is distributed: the counts of all words, and those of all phrases. What is sent to all tasks is bounded: a dictionary
of DICTIONARY words at most, and the tables of the short contexts, whose symbols are the tree's leaves. All sums are over documents, so
results do not depend on how many tasks there are (but for the order in which floating-point numbers are added).
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.text import crc_fold
from corvane.runtime import discard, materialise, ship, table

END = b"\n"
FOLDS, SMOOTH = 10, 0.1
#: Words sent to all tasks at most; those with a leaf of their own; buckets of the others; leaves that count as very common.
DICTIONARY, SYMBOLS, BUCKETS, COMMON = 400_000, 1_024, 512, 255
#: Slots of the contexts' tables as powers of two: the last very common word, the word before, the two words before.
TABLE_BITS, LEAST_BITS = (18, 20, 20), 14
ORDERS, GATES, PRIOR, BLOCK_BITS = 3, 16, 0.35, 15
#: Words along which a text's weights are kept before they learn; what holds back their change; words at once in a task.
STEP, INERTIA, TOKENS_AT_ONCE = 64, 40.0, 60_000
#: Distinct words that a task counts before it sends them; words of which one task counts the contexts.
FLUSH, TOKENS_A_TASK = 200_000, 40_000_000
#: A phrase has so many words on the mean; phrases of at least 1 / COMMON_PHRASES of all are sent to all tasks.
PHRASE, COMMON_PHRASES = 12, 50_000
#: Bins of the probability map; mixed inputs are rounded to 1 / FINE within their range before the last lookup.
MAP_BINS, MAP_RANGE, FINE, FINE_RANGE = 33, 8.0, 32, 12
SPELL_PRIOR = 4.0
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0x94D049BB133111EB)


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def hash_of(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 42)


def bucket_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % BUCKETS


#: Buckets by the last two bytes of a word, the last one low, and of words of one byte.
_PAIR = np.array([bucket_of(bytes((k >> 8, k & 255))) for k in range(1 << 16)], np.int64)
_ONE = np.array([bucket_of(bytes((k,))) for k in range(256)], np.int64)


def buckets_of(tokens: list[bytes]) -> np.ndarray:
    """``bucket_of`` of each word."""
    flat = np.frombuffer(b"".join(tokens), np.uint8).astype(np.intp)
    lens = np.fromiter(map(len, tokens), np.intp, len(tokens))
    last = np.cumsum(lens) - 1
    return np.where(lens > 1, _PAIR[flat[last - 1] * 256 + flat[last]], _ONE[flat[last]])


class Tree:
    """Huffman paths of the leaves: nodes, bits, the nodes' stretched shares of ones and salts of hashes, one path after another; ``plain`` has these shares by node."""

    def __init__(self, masses: np.ndarray):
        n = len(masses)
        heap = [(float(m) + 1.0, k) for k, m in enumerate(masses)]
        heapq.heapify(heap)
        kids, weight = np.zeros((n, 2), np.int64), np.concatenate([np.asarray(masses, np.float64) + 1.0, np.zeros(n)])
        fresh = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[fresh - n] = a[1], b[1]
            weight[fresh] = a[0] + b[0]
            heapq.heappush(heap, (weight[fresh], fresh))
            fresh += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        stack: list[tuple[int, list[tuple[int, int]]]] = [(fresh - 1, [])]
        while stack:
            at, path = stack.pop()
            if at < n:
                paths[at] = path
            else:
                stack += [(int(kids[at - n, bit]), [*path, (at - n, bit)]) for bit in (0, 1)]
        self.length = np.array([len(p) for p in paths], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        flat = [x for p in paths for x in p]
        self.node, self.bit = (np.array([x[k] for x in flat], t) for k, t in ((0, np.int32), (1, np.int8)))
        inner = kids[: max(fresh - n, 1)]
        self.plain = np.log(weight[inner[:, 1]] / weight[inner[:, 0]]).astype(np.float32)
        self.share = self.plain[self.node]
        with np.errstate(over="ignore"):
            self.salt = (self.node.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)


#: Kinds of bytes in a word: the end, letters, digits, other ASCII, and the rest by their low bits.
_KIND = np.array([0 if b == 32 else 1 + b - 97 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 + (b & 31) if b >= 128 else 60 + (b & 3) for b in range(256)])


def spelled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with a space after each, the two kinds before each as one number, and the words' first places."""
    flat = np.frombuffer(b" ".join([*tokens, b""]), np.uint8)
    kind = _KIND[flat]
    ahead = np.concatenate([[0, 0], kind])
    lens = np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))
    starts = np.cumsum(lens) - lens
    second = ahead[:-2].copy()
    second[starts] = 0
    return flat, second * 64 + ahead[1:-1], starts


def spelling(counts: np.ndarray) -> np.ndarray:
    """log10 probability of a byte after the kinds of the two before it, by [4096, 256] counts; what is rare leans on one kind."""
    c = counts.reshape(64, 64, 256)
    one = c.sum(0)
    one = (one + 1) / (one.sum(1, keepdims=True) + 256)
    return np.log10((c + SPELL_PRIOR * one) / (c.sum(2, keepdims=True) + SPELL_PRIOR)).astype(np.float32).reshape(4096, 256)


class Words:
    """The dictionary, by falling counts, with what each word and each bucket is worth."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, tail: np.ndarray, n: int, v: int, spell: np.ndarray):
        self.tokens, self.counts, self.tail, self.n, self.v, self.spell = tokens, counts, tail, n, v, spell
        self.symbols = min(SYMBOLS, len(tokens))
        bucket = buckets_of(tokens[self.symbols :])
        rare = counts[self.symbols :].astype(np.float64)
        mass = tail + 1.0 + np.bincount(bucket, rare, minlength=BUCKETS)
        self.masses = np.concatenate([counts[: self.symbols], mass])
        self.leaf = np.concatenate([np.arange(self.symbols), self.symbols + bucket]).astype(np.int32)
        self.inner = np.concatenate([np.zeros(self.symbols), np.log10(rare / mass[bucket])])
        self.escape, self.alone = np.log10((tail + 1.0) / mass), -np.log10(tail + 1.0)
        self.base = np.log10((counts + SMOOTH) / (n + SMOOTH * (v + 1)))
        self.known = (counts > 0).astype(np.int64)

    def index(self) -> None:
        self.at = {t: k for k, t in enumerate(self.tokens)}
        self.hash = np.fromiter(map(hash_of, self.tokens), np.uint64, len(self.tokens))

    def look_up(self, words: list[bytes]):
        """Of each word leaf, log10 share within the leaf, log10 base, whether known, and what stands for it in phrases; then the
        words outside the dictionary: places, log10 share of one occurrence among those of their bucket, hashes. For these the share
        within the leaf is that of all such words, and their bucket stands for them."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        leaf, inner, base, known, h = self.leaf[at], self.inner[at], self.base[at], self.known[at], self.hash[at]
        out = np.flatnonzero(at < 0)
        some = [words[k] for k in out.tolist()]
        bucket = buckets_of(some)
        leaf[out], inner[out], base[out], known[out] = self.symbols + bucket, self.escape[bucket], 0.0, 0
        with np.errstate(over="ignore"):
            h[out] = (bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[3])
        return leaf, inner, base, known, h, out, self.alone[bucket], np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(42)), np.uint64, len(some))

    def log10_spelled(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        flat, context, starts = spelled(words)
        return np.add.reduceat(self.spell[context, flat].astype(np.float64), starts)


def phrases(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and keys of the phrases of some texts, whose words' hashes follow one another."""
    ends = np.cumsum(sizes)
    last = np.zeros(len(h), bool)
    last[ends - 1] = True
    before = np.concatenate([h[:1], h[:-1]])
    before[ends - sizes] = hash_of(END)
    with np.errstate(over="ignore"):
        last |= ((h ^ before * np.uint64(_ODD[0])) >> np.uint64(20)) % np.uint64(PHRASE) == 0
        starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        lens = np.diff(starts, append=len(h))
        within = np.arange(len(h)) - np.repeat(starts, lens)
        power = np.full(int(lens.max(initial=0)) + 1, _ODD[1], np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        keys = np.add.reduceat(h * power[within], starts) * np.uint64(_ODD[2]) ^ lens.astype(np.uint64)
    return starts, keys


#: Counts that a slot tells apart: each up to 63, then in steps of a fifth.
_LEVELS = np.concatenate([np.arange(64.0), np.rint(64 * 1.2 ** np.arange(64))])
_HALF = 7


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts [slots, 2] of zeros and ones as one number a slot, the levels of both."""
    level = (np.searchsorted(_LEVELS, counts, side="right") - 1).astype(np.uint16)
    return level[:, 0] | level[:, 1] << np.uint16(_HALF)


def _stretched() -> tuple[np.ndarray, np.ndarray]:
    """By slot content, with nothing, a one or a zero left out: the stretched prediction and how much it has seen (four levels)."""
    zeros, ones = np.tile(_LEVELS, len(_LEVELS)), np.repeat(_LEVELS, len(_LEVELS))
    told, seen = [], []
    for one, zero in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(zeros - zero, 0), np.maximum(ones - one, 0)
        n = a + b
        told.append((np.log(b + PRIOR) - np.log(a + PRIOR)) * n / (n + 0.5))
        seen.append((n > 1).astype(np.int8) + (n > 12) + (n > 150))
    return np.concatenate(told).astype(np.float32), np.concatenate(seen).astype(np.int8)


_TOLD, _SEEN = _stretched()


def squash(s: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(s, -14, 14)))


def start_weights() -> np.ndarray:
    """By gate for the node's own share, the three contexts and a bias."""
    return np.tile(np.array([0.2, 0.5, 0.4, 0.1, 0.0], np.float32), (GATES, 1))


def map_start() -> np.ndarray:
    return np.tile(squash(np.linspace(-MAP_RANGE, MAP_RANGE, MAP_BINS)), (GATES, 1))


class Run:
    """The decisions of some texts (arrays of leaves), ordered by step of STEP words, then text."""

    def __init__(self, tree: Tree, symbols: int, bits: tuple[int, ...], texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        self.order = np.argsort(-sizes, kind="stable")  # long texts first, so that those still running come first
        sizes = sizes[self.order]
        leaf = np.concatenate([texts[k] for k in self.order]).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        place = np.arange(len(leaf), dtype=np.int32)
        pos = place - starts.astype(np.int32)[doc]
        none = len(tree.length)  # what lies before the text
        one, two = (np.where(pos >= k, leaf[np.maximum(place - k, 0)], none) for k in (1, 2))
        common = np.where(one < min(COMMON, symbols), one, -1)
        seen = np.maximum.accumulate(np.where((common >= 0) | (pos == 0), place, 0))
        common = np.where(common[seen] < 0, none, common[seen])
        step = pos // STEP
        words = np.argsort(step.astype(np.int16) if step.max() < 1 << 15 else step, kind="stable")
        leaf, doc = leaf[words], doc[words]
        length = tree.length[leaf]
        ends = np.cumsum(length)
        self.first = ends - length
        self.path = np.repeat(tree.start[leaf] - self.first, length)  # places are of numpy's own kind, so that they aren't converted by each look-up
        self.path += np.arange(ends[-1])
        self.bit, salt = tree.bit[self.path], tree.salt[self.path]
        self.words, self.sizes, self.starts = words, sizes, starts
        last = np.flatnonzero((np.diff(step[words], append=-1) != 0) | (np.diff(doc, append=-1) != 0))  # of a text within a step
        self.parts = np.concatenate([[0], ends[last]])
        self.texts_of_step = np.bincount(step[words][last])
        self.doc = np.repeat(doc, length)
        with np.errstate(over="ignore"):
            self.slots = []
            for c, b in zip((common, one, one * (none + 1) + two), bits):
                h = c[words].astype(np.uint32) * np.uint32(0xC2B2AE35)
                h = np.repeat(h ^ h >> np.uint32(15), length)
                h += salt
                h ^= h >> np.uint32(13)
                h *= np.uint32(0x9E3779B1)
                h >>= np.uint32(32 - b)
                self.slots.append(h.astype(np.intp))

    def inputs(self, tables: list[np.ndarray], share: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions [ORDERS + 2, decisions] and gates; ``own`` says by text (in self.order) whether its counts are in the tables."""
        x = np.empty((ORDERS + 2, len(self.bit)), np.float32)
        np.take(share, self.path, out=x[0], mode="clip")
        out = (2 - self.bit).astype(np.intp) << 2 * _HALF
        if not own.all():
            out *= own[self.doc]
        gate = np.zeros(len(self.bit), np.int8)
        for k, (t, slots) in enumerate(zip(tables, self.slots), 1):
            at = out + t[slots]
            np.take(_TOLD, at, out=x[k], mode="clip")
            if k > 1:
                gate = gate * 4 + _SEEN[at]
        x[ORDERS + 1] = 0.3
        return x, gate.astype(np.intp)

    def mixed(self, weights: np.ndarray, x: np.ndarray, gate: np.ndarray, online: bool = True) -> np.ndarray:
        """The mixed inputs of each decision: with what a text adds to the weights it predicts a step, then learns from it."""
        out = np.zeros(len(self.bit), np.float32)
        for k, row in enumerate(x):
            out += np.take(weights[:, k], gate) * row
        if not online:
            return out
        added, bent = np.zeros((len(self.sizes), len(x)), np.float32), np.full((len(self.sizes), len(x)), INERTIA, np.float32)
        at = 0
        for m in self.texts_of_step.tolist():
            ends = self.parts[at : at + m + 1]
            at += m
            lo, hi, lens, firsts = ends[0], ends[-1], np.diff(ends), ends[:-1] - ends[0]
            some, s = x[:, lo:hi], out[lo:hi]
            if lo:
                for k, row in enumerate(some):
                    s += np.repeat(added[:m, k], lens) * row
            if at == len(self.parts) - 1:
                break
            p = 1.0 / (1.0 + np.exp(-s))
            err, bend = self.bit[lo:hi] - p, p * (1 - p)
            slope = np.stack([np.add.reduceat(err * row, firsts) for row in some], 1)
            bent[:m] += (ORDERS + 1) * np.stack([np.add.reduceat(bend * row * row, firsts) for row in some], 1)
            added[:m] += slope / bent[:m]
        return out

    def by_word(self, logs: np.ndarray) -> list[np.ndarray]:
        """Sums over the words of each text, in the texts' order as given, of what is told of each decision."""
        flat = np.empty(len(self.words))
        flat[self.words] = np.add.reduceat(logs, self.first)  # each path has a decision
        back: list = [None] * len(self.sizes)
        for k, part in zip(self.order, np.split(flat, self.starts[1:])):
            back[k] = part
        return back


def cells_of(s: np.ndarray) -> np.ndarray:
    return (np.clip(s, -MAP_RANGE, MAP_RANGE - 1e-3) + MAP_RANGE) * ((MAP_BINS - 1) / (2 * MAP_RANGE))


def final_log10(probability_map: np.ndarray) -> np.ndarray:
    """By gate, bit and rounded mixed input: log10 of the bit's probability, the mean of the mixer's and the map's."""
    s = (np.arange(2 * FINE_RANGE * FINE) + 0.5) / FINE - FINE_RANGE
    at = cells_of(s)
    lo = at.astype(np.int64)
    p = 0.5 * squash(s) + 0.5 * (probability_map[:, lo] * (1 - (at - lo)) + probability_map[:, lo + 1] * (at - lo))
    return np.log10(np.stack([1 - p, p], 1)).ravel()


def look_up(final: np.ndarray, s: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
    fine = ((np.clip(s, -FINE_RANGE, FINE_RANGE - 1e-3) + np.float32(FINE_RANGE)) * np.float32(FINE)).astype(np.int32)
    return final[(gate * 2 + bit) * (2 * FINE_RANGE * FINE) + fine]


def table_bits(tokens: int) -> tuple[int, ...]:
    """Slots as powers of two for so many running words, within TABLE_BITS."""
    want = max(LEAST_BITS, (32 * tokens).bit_length())
    return tuple(min(b, want) for b in TABLE_BITS)


_held: dict = {}


class Sent:
    """An object broadcast compressed, opened and prepared once in each worker."""

    def __init__(self, spark: SparkSession, value, prepare=None):
        self.mark, self.prepare = uuid.uuid4().hex, prepare
        self.sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(value, 5), 1))

    def get(self):
        if self.mark not in _held:
            _held.clear()
            value = pickle.loads(zlib.decompress(self.sent.value))
            if self.prepare:
                self.prepare(value)
            _held[self.mark] = value
        return _held[self.mark]


def token_table(docs: DataFrame) -> DataFrame:
    """(token, c): every distinct word of the training documents and its count."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
            counts.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > FLUSH:
                    yield from out()
        yield from out()

    rows = docs.where(crc_fold(F.col("doc_id"), FOLDS) > 0).select("text").mapInArrow(run, "token binary, c long")
    return rows.groupBy("token").agg(F.sum("c").alias("c"))


def dictionary(tokens: DataFrame) -> tuple[Words, Column]:
    """The model of words from the token table, and the condition that a row of it is outside the dictionary."""
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    cell = F.floor(F.log2("c") * 8).cast("int")
    room, least = DICTIONARY, None
    for k, m in sorted(map(tuple, tokens.groupBy(cell.alias("cell")).count().collect()), reverse=True):  # some hundred cells at most
        room -= m
        if room < 0:
            break
        least = k
    outside = (cell < least if least is not None else F.lit(True)) & (F.col("token") != F.lit(bytearray(END)))  # the end is always within
    some = tokens.where(~outside).select("token", "c").toArrow().to_pydict()  # DICTIONARY rows at most
    found = dict(zip(some["token"], some["c"]))
    found.setdefault(END, 0)
    order = sorted(found, key=lambda t: (-found[t], t))
    if END in order[SYMBOLS:]:  # it has a leaf of its own, however rare
        order.remove(END)
        order.insert(0, END)
    tail = np.zeros(BUCKETS)
    bucket = F.pmod(F.crc32(F.when(F.length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))), F.lit(BUCKETS)).cast("int")
    for b, m in tokens.where(outside).groupBy(bucket.alias("b")).agg(F.sum("c")).collect():
        tail[b] = m

    def count(batches):
        seen = np.zeros(4096 * 256)
        for b in batches:
            flat, context, _ = spelled(b.column(0).to_pylist())
            seen += np.bincount(context * 256 + flat, minlength=len(seen))
        yield _block(0, seen)

    tasks = max(1, -(-v // 2_000_000))
    rare = _summed(tokens.where(outside).select("token").coalesce(tasks).mapInArrow(count, "block int, m binary"))
    return Words(order, np.array([found[t] for t in order], np.int64), tail, n, v, spelling(rare[0].reshape(4096, 256))), outside


def _block(k: int, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(a.astype(np.float64).tobytes(), 1)], pa.binary())], names=["block", "m"])


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Elementwise sums of the arrays of each block, in two levels: one row a block, a bounded number of them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in pdf["m"]:
            total = total + np.frombuffer(zlib.decompress(x), np.float64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "m": [zlib.compress(total.tobytes(), 1)]})

    few = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("block", "salt").applyInPandas(add, "block int, m binary")
    rows = few.groupBy("block").applyInPandas(add, "block int, m binary").collect()
    return {r["block"]: np.frombuffer(zlib.decompress(r["m"]), np.float64) for r in rows}


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def encoded(docs: DataFrame, words: Sent) -> DataFrame:
    """One row for each of ``docs``: its leaves, its phrases (key, words, log10 of the shares within leaves), its different words outside
    the dictionary (hash, times, log10 of the spelling in held-out rows), and what the dictionary tells of the base."""
    import zstandard

    def run(batches):
        w, row, z = words.get(), TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        for ids, folds, texts in _texts(batches):
            found = [tokens_of(t) for t in texts]
            sizes = np.array([len(x) for x in found])
            flat = [t for x in found for t in x]
            leaf, inner, base, known, h, out, alone, names = w.look_up(flat)
            doc, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            starts, keys = phrases(h, sizes)
            per_doc = np.bincount(doc[starts], minlength=len(sizes))
            order = np.lexsort((names, doc[out]))
            d, k = doc[out][order], names[order]
            new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.zeros(0, np.int64)
            rare = np.bincount(d[new], minlength=len(sizes))
            held = folds == 0
            spell = np.zeros(len(new))
            fresh = held[d[new]]  # training texts have no unknown words
            spell[fresh] = w.log10_spelled([flat[i] for i in out[order[new[fresh]]].tolist()])
            rows = (row + np.arange(len(sizes))) * 2 + held  # the last bit tells the held-out rows
            row += len(sizes)
            total = lambda x: np.add.reduceat(x, ends - sizes)
            arrays = [
                pa.array(rows), ids, pa.array(folds), pa.array(sizes), pa.array(np.add.reduceat(np.fromiter(map(len, flat), np.int64, len(flat)), ends - sizes) + sizes - 1), pa.array(total(known)), pa.array(total(base)), pa.array(np.bincount(doc[out], alone, minlength=len(sizes)).astype(np.float64)),
                pa.array([z.compress(x.astype(np.uint16).tobytes()) for x in np.split(leaf, ends[:-1])], pa.binary()), _lists(keys.view(np.int64), per_doc, pa.int64()),
                _lists(np.diff(starts, append=len(h)), per_doc, pa.int32()), _lists(np.add.reduceat(inner, starts), per_doc, pa.float32()),
                _lists(k[new].view(np.int64), rare, pa.int64()), _lists(np.diff(new, append=len(d)), rare, pa.int32()), _lists(spell, rare, pa.float32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "fold", "n_tokens", "n_bytes", "known", "base", "alone", "leaves", "phrases", "lens", "inner", "rare", "times", "spell"])

    schema = "row long, doc_id long, fold int, n_tokens long, n_bytes long, known long, base double, alone double, leaves binary, phrases array<long>, lens array<int>, inner array<float>, rare array<long>, times array<int>, spell array<float>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_fold(F.col("doc_id"), FOLDS).alias("fold"), F.col("text")).mapInArrow(run, schema)


def _texts(batches):
    """Ids, folds and texts, so many at once that they stay small."""
    for b in batches:
        texts, folds = b.column(2).to_pylist(), b.column(1).to_numpy()
        lo = size = 0
        for k, t in enumerate(texts):
            size += len(t or "") + 1
            if size > 8 * TOKENS_AT_ONCE or k + 1 == len(texts):
                yield b.column(0).slice(lo, k + 1 - lo), folds[lo : k + 1], texts[lo : k + 1]
                lo, size = k + 1, 0


def _leaves(batches, column: int):
    """Slices of the batches with their texts' leaves, TOKENS_AT_ONCE or so at a time."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        lo, size, held = 0, 0, []
        for k, packed_ in enumerate(b.column(column)):
            held.append(np.frombuffer(z.decompress(packed_.as_py()), np.uint16))
            size += len(held[-1])
            if size > TOKENS_AT_ONCE or k + 1 == b.num_rows:
                yield b.slice(lo, k + 1 - lo), held
                lo, size, held = k + 1, 0, []


class Mixer:
    """What predicts the decisions, sent to all tasks: tree, tables, weights and, at last, the map."""

    def __init__(self, tree: Tree, symbols: int, tables: list[np.ndarray], weights: np.ndarray, final: np.ndarray | None = None):
        self.tree, self.symbols, self.tables, self.weights, self.final = tree, symbols, tables, weights, final
        self.bits = tuple(len(t).bit_length() - 1 for t in tables)

    def predict(self, texts: list[np.ndarray], own: np.ndarray, online: bool = True):
        """Decisions, their inputs, gates and mixed inputs; ``own``: whether a text's counts are in the tables."""
        run = Run(self.tree, self.symbols, self.bits, texts)
        x, gate = run.inputs(self.tables, self.tree.share, own[run.order])
        return run, x, gate, run.mixed(self.weights, x, gate, online)

    def log10(self, texts: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
        """log10 probability of the leaves of each text."""
        run, _, gate, s = self.predict(texts, own)
        return run.by_word(look_up(self.final, s, gate, run.bit))


def context_tables(rows: DataFrame, tree: Tree, symbols: int, tokens: int) -> list[np.ndarray]:
    """Counts of zeros and ones by slot over the training rows' ``leaves``; their size is bounded by TABLE_BITS."""
    spark = rows.sparkSession
    bits, sent = table_bits(tokens), Sent(spark, tree)
    edges = np.cumsum([0, *(1 << (b + 1) for b in bits)])
    step = 1 << BLOCK_BITS

    def count(batches):
        dense = np.zeros(edges[-1], np.uint32)
        for _, texts in _leaves(batches, 0):
            run = Run(sent.get(), symbols, bits, texts)
            for edge, slots in zip(edges, run.slots):
                np.add.at(dense, edge + 2 * slots + run.bit, np.uint32(1))
        for k in np.flatnonzero(dense.reshape(-1, step).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(dense[k * step : (k + 1) * step].tobytes(), 1)], pa.binary())], names=["block", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.uint64)
        for x in pdf["m"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "m": [zlib.compress(packed(total.reshape(-1, 2)).tobytes(), 1)]})

    tasks = max(1, -(-tokens // TOKENS_A_TASK), min(spark.sparkContext.defaultParallelism, -(-tokens // 1_000_000)))
    parts = rows.where("fold > 0").select("leaves").coalesce(tasks).mapInArrow(count, "block int, m binary")
    dense = np.zeros(edges[-1] // 2, np.uint16)
    for r in parts.groupBy("block").applyInPandas(add, "block int, m binary").toLocalIterator():  # the tables' size at most
        dense[r["block"] * step // 2 : (r["block"] + 1) * step // 2] = np.frombuffer(zlib.decompress(r["m"]), np.uint16)
    return [dense[a // 2 : b // 2] for a, b in zip(edges, edges[1:])]


def learn_weights(rows: DataFrame, sent: Sent) -> np.ndarray:
    """By gate one Newton step of the logistic loss from the start weights, over ``leaves`` of training rows."""
    n = ORDERS + 2

    def run(batches):
        m, total = sent.get(), np.zeros((GATES, n, n + 1))
        for _, texts in _leaves(batches, 0):
            r, x, gate, s = m.predict(texts, np.ones(len(texts), bool), online=False)
            p = 1.0 / (1.0 + np.exp(-s))
            err, bend = r.bit - p, p * (1 - p)
            order = np.argsort(gate.astype(np.int8), kind="stable")
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            by_gate = np.empty((n + 2, len(order)), np.float32)
            for row, to in zip((*x, err, bend), by_gate):
                np.take(row, order, out=to, mode="clip")
            for g, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
                part = by_gate[:, lo:hi]
                total[g] += np.column_stack([(part[:n] * part[n + 1]) @ part[:n].T, part[:n] @ part[n]])
        yield _block(0, total.ravel())

    total = _summed(rows.select("leaves").mapInArrow(run, "block int, m binary")).get(0, np.zeros(GATES * n * (n + 1))).reshape(GATES, n, n + 1)
    return np.array([w + np.linalg.solve(t[:, :n] + 10 * np.eye(n), t[:, n]) for w, t in zip(start_weights(), total)], np.float32)


def fill_map(rows: DataFrame, sent: Sent) -> np.ndarray:
    """The probability map: by gate and mixed input the share of ones among ``leaves``' decisions of training rows, predicted online."""

    def run(batches):
        m, both = sent.get(), np.zeros((2, GATES * MAP_BINS))
        for _, texts in _leaves(batches, 0):
            r, _, gate, s = m.predict(texts, np.ones(len(texts), bool))
            cell = gate * MAP_BINS + np.rint(cells_of(s)).astype(np.int32)
            both += np.bincount(cell * 2 + r.bit, minlength=both.size).reshape(-1, 2).T
        yield _block(0, both.ravel())

    zeros, ones = _summed(rows.select("leaves").mapInArrow(run, "block int, m binary")).get(0, np.zeros(2 * GATES * MAP_BINS)).reshape(2, GATES, MAP_BINS)
    return np.clip((ones + 20 * map_start()) / (zeros + ones + 20), 1e-6, 1 - 1e-6)


def phrase_rows(rows: DataFrame, sent: Sent) -> DataFrame:
    """(row, key, lm): each phrase of each text and the log10 probability of its words."""

    def run(batches):
        m = sent.get()
        for b, texts in _leaves(batches, 1):
            ids, keys, lens, inner = b.column(0).to_numpy(), b.column(2).flatten(), b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
            told = np.concatenate(m.log10(texts, ids % 2 == 0))
            lm = np.add.reduceat(told, np.cumsum(lens) - lens) + inner
            of = np.repeat(ids, pc.list_value_length(b.column(2)).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(of), keys, pa.array(lm.astype(np.float32))], names=["row", "key", "lm"])

    return rows.select("row", "leaves", "phrases", "lens", "inner").mapInArrow(run, "row long, key long, lm float")


def phrase_counts(found: DataFrame, total: int) -> DataFrame:
    """``found`` (row, key, lm) with c, the times that a training row other than this one's occurrence has the phrase.

    Phrases that are common enough, a number bounded by arithmetic, are sent to all tasks, so no key of the join is hot.
    """
    new = F.col("row").bitwiseAND(F.lit(1))
    counts = found.groupBy("key").agg(F.sum(1 - new).alias("k"), F.count("*").alias("n")).where("n > 1 and k > 0")
    counts = materialise(counts, "phrases")
    common = F.col("n") * COMMON_PHRASES >= total
    first = found.join(F.broadcast(counts.where(common).select("key", F.col("k").alias("k1"))), "key", "left")
    second = first.where("k1 is null").select("row", "key", "lm").join(counts.where(~common).select("key", "k"), "key", "left")
    both = first.where("k1 is not null").select("row", "lm", F.col("k1").alias("k")).union(second.select("row", "lm", F.coalesce("k", F.lit(0)).alias("k")))
    return both.select("row", "lm", F.greatest(F.col("k") - 1 + new, F.lit(0)).alias("c"))


def learn_share(told: DataFrame, whole: int) -> float:
    """Share of the phrases' own frequency beside the product over their words: the likeliest for the training text."""
    better = F.when(F.col("c") > 0, F.greatest(F.least(F.round(10 * (F.log10(F.col("c") / whole) - F.col("lm"))), F.lit(2500.0)), F.lit(-2500.0)).cast("int"))
    cells = told.where(F.col("row").bitwiseAND(F.lit(1)) == 0).groupBy(better.alias("better")).count().collect()  # 5,002 cells at most
    ratio, mass = np.array([[1.0, 1.0], *((0.0 if b is None else 10.0 ** (b / 10), m) for b, m in cells)]).T
    share = 0.5
    for _ in range(200):
        share = float((mass * share * ratio / (share * ratio + 1 - share)).sum() / mass.sum())
    return min(max(share, 1e-6), 1 - 1e-6)


def phrase_log10(share: float, whole: int) -> Column:
    """log10 probability of a phrase, given (c, lm)."""
    words, own = F.lit(math.log10(1 - share)) + F.col("lm"), F.lit(math.log10(share)) + F.log10(F.col("c") / whole)
    return F.when(F.col("c") <= 0, words).otherwise(F.greatest(words, own) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(words - own))))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, n_bytes) for each row of ``docs``.

    Learns from rows outside fold 0 (crc32 of the id as text modulo 10). score is the model's log10 probability of the words in their
    order with their end, with a training row's own counts left out of its contexts and phrases. As in the base, a word that no training text has
    is one event; spelled_score pays for the bytes of such words besides, so bits per byte are -spelled_score / log10(2) / n_bytes.
    Only doc_id and text are read; other columns may have any names.
    Null and empty texts have the end alone; a null id is in fold 0; repeated rows are scored each; an empty table gives no rows. Without a training row
    the base gives each word what its formula gives and the model is uniform.
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = materialise(token_table(docs), "tokens")
    words, outside = dictionary(tokens)
    n, tree, symbols = int(words.n), Tree(words.masses), words.symbols
    rows = materialise(encoded(docs, Sent(spark, words, Words.index)), "encoded")
    tables = context_tables(rows, tree, symbols, n)
    weights = learn_weights(rows.where("fold between 1 and 5"), Sent(spark, Mixer(tree, symbols, tables, start_weights())))
    final = final_log10(fill_map(rows.where("fold > 5"), Sent(spark, Mixer(tree, symbols, tables, weights))))
    found = materialise(phrase_rows(rows, Sent(spark, Mixer(tree, symbols, tables, weights, final))), "phrase-rows")
    heads = materialise(rows.select("row", "doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_bytes", "known", "base", "alone"), "heads")
    whole = SMOOTH * (words.v + 1) + n
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times", "spell")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("m"), "x.spell")
    counts = tokens.where(outside).select(F.xxhash64("token").alias("key"), "c")
    c, m = F.coalesce("c", F.lit(0)), F.col("m")
    base = rare.join(counts, "key", "left").select("row", F.when(c > 0, m).otherwise(0).alias("k"), (m * F.log10((c + SMOOTH) / whole)).alias("b"), F.when(c > 0, m * F.log10(c)).otherwise(0.0).alias("s"), F.when(c > 0, 0.0).otherwise(m * F.col("spell")).alias("u"))
    base = materialise(base.groupBy("row").agg(F.sum("k").cast("long").alias("k"), *(F.sum(x).alias(x) for x in "bsu")), "rare")
    discard(rows, tokens)
    total, trained = found.agg(F.count("*"), F.coalesce(F.sum(1 - F.col("row").bitwiseAND(F.lit(1))), F.lit(0))).first()
    told = materialise(phrase_counts(found, total), "phrases-told")
    discard(found)
    trained = max(int(trained), 1)
    sums = told.groupBy("row").agg(F.sum(phrase_log10(learn_share(told, trained), trained)).alias("lm"))
    more = lambda x: F.coalesce(x, F.lit(0))
    out = heads.join(sums, "row").join(base, "row", "left").withColumn("score", F.col("lm") + F.col("alone") + more("s"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("b")).alias("base_score"), "score", (F.col("score") + more("u")).alias("spelled_score"), "n_bytes",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``documents`` each row's score, as :func:`score` defines it for nulls, empty texts and repeated rows, and its bits per byte."""
    return score(table(spark, sf_dir, "documents")).withColumn("bits_per_byte", -F.col("spelled_score") / math.log10(2) / F.col("n_bytes"))
