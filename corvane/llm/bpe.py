"""Byte-pair encoding and decoding by segment trees over the ranks of adjacent pairs.

A piece of text is a row of symbols. The leaves of its tree hold the ranks of adjacent pairs, packed
with their positions, and each inner node the least of its two children, so the root names the leftmost
pair of the lowest rank. Merging it changes three leaves at most, whose paths to the root are
renewed; the piece is done when no leaf holds a mergeable pair. A batch's distinct pieces
are worked side by side, a tree each, in classes of equal width, as array steps over all trees that are not done.

Only pieces that a worker doesn't know yet are merged; its memo is bounded. No step depends on other rows, so there is no shuffle.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.tokencount import _NOT_SPACE, _PIECES, _splits_at_space
from corvane.runtime import ship, table

#: Pieces that a worker remembers, and the length beyond which it doesn't.
MEMO, LONG = 400_000, 1_000
#: Bytes of text, or of ids, that are worked at once; a longer text is worked alone.
SLICE = 4_000_000
#: Letters below this one are Latin.
LATIN = 0x250
_NONE = np.iinfo(np.int64).max
_open: dict = {}


class Forest:
    """Merges the symbols of many pieces, each under a segment tree of its own."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        """``pairs`` (n, 2): the symbols of each merge in order of rank; ``merged``: the symbol that takes their place."""
        keys = self._key(pairs[:, 0], pairs[:, 1])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged.astype(np.int32)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE if it can't merge or a side is absent (below zero)."""
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all pieces, one after the other, and their numbers a piece, when no pair merges any more."""
        starts = np.cumsum(lengths) - lengths
        out = symbols.astype(np.int32)
        width = np.where(lengths > 1, 2 ** np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64), 1)
        for w in np.unique(width[width > 1]):
            mine = np.flatnonzero(width == w)
            for some in np.array_split(mine, max(1, len(mine) * int(w) // 2**18)):
                self._merge_class(out, starts[some], lengths[some], int(w))
        alive = out >= 0
        ends = np.concatenate([[0], np.cumsum(alive)])
        return out[alive], ends[starts + lengths] - ends[starts]

    def _merge_class(self, out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> None:
        """Merges pieces of at most ``width`` symbols in place; a symbol that its left neighbour has taken up becomes -1."""
        n, place = len(starts), np.arange(width)
        inside = place[:, None] < lengths[None, :]
        sym = np.full((width + 1, n), -1, np.int32)
        sym[:-1][inside] = out[(starts[None, :] + place[:, None])[inside]]
        after = np.minimum(np.broadcast_to(place[:, None] + 1, (width, n)), lengths[None, :]).astype(np.int32)
        after[after == lengths[None, :]] = width
        before = np.broadcast_to(np.arange(-1, width)[:, None], (width + 1, n)).astype(np.int32)
        tree = np.full((2 * width, n), _NONE, np.int64)
        tree[width:] = self._leaf(self.rank(sym[:-1], sym[1:]), place[:, None], width)
        for level in range(width - 1, 0, -1):
            tree[level] = np.minimum(tree[2 * level], tree[2 * level + 1])
        todo = np.flatnonzero(tree[1] != _NONE)
        while len(todo):
            root = tree[1, todo]
            at = root % width
            taken = after[at, todo]
            sym[at, todo] = self.merged[root // width]
            sym[taken, todo] = -1
            follower = after[taken, todo]
            after[at, todo] = follower
            before[follower, todo] = at
            left = before[at, todo]
            tree[width + at, todo] = self._leaf(self.rank(sym[at, todo], sym[follower, todo]), at, width)
            tree[width + taken, todo] = _NONE
            has = left >= 0
            tree[width + left[has], todo[has]] = self._leaf(self.rank(sym[left[has], todo[has]], sym[at[has], todo[has]]), left[has], width)
            node, trees = np.concatenate([at, taken, left[has]]) + width, np.concatenate([todo, todo, todo[has]])
            while node[0] > 1:
                node = node >> 1
                tree[node, trees] = np.minimum(tree[2 * node, trees], tree[2 * node + 1, trees])
            todo = todo[tree[1, todo] != _NONE]
        out[(starts[None, :] + place[:, None])[inside]] = sym[:-1][inside]

    @staticmethod
    def _leaf(rank: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        return np.where(rank == _NONE, _NONE, np.where(rank == _NONE, 0, rank) * width + place)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others by count from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = itertools.count(256)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Codec:
    """Ids and tokens of a file whose model is BPE over the bytes of pieces, cut and normalised by known rules; other files are refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("decoder") or not _splits_at_space(spec) or any(t["normalized"] for t in added):
            raise ValueError(f"{path}: not a BPE over bytes of the kind that is known here")
        known = Tokenizer.from_file(path)
        self.normalise, self.split = known.normalizer.normalize_str, known.pre_tokenizer[0].pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added if t["content"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        latin = sorted({x for c in range(LATIN) for x in chr(c) + chr(c).lower()})
        letters, numbers = ("".join(c for c in latin if unicodedata.category(c)[0] == k) for k in "LN")
        self.latin = re.compile(f"[^{_NOT_SPACE}{chr(LATIN)}-\U0010ffff]*")
        self.pattern = re.compile(_PIECES.replace(r"\p{L}", letters).replace(r"\p{N}", numbers))

        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.forest = Forest(np.array([(vocab[a], vocab[b]) for a, b in merges]), np.array([vocab[a + b] for a, b in merges]))
        end = model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int32)
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.memo: dict[str | int, bytes] = {}

    def pieces(self, text: str) -> list[str | int]:
        """The pieces between which nothing merges, normalised, and the ids of special tokens that stand in the text.

        Text of Latin letters, which all are in normal form, is lowered and cut here; the file's own rules cut any other.
        """
        if self.latin.fullmatch(text) and not self.at_special.search(text):
            return self.pattern.findall(text.lower())
        out: list[str | int] = []
        at = 0
        for m in self.at_special.finditer(text):
            out += [p for p, _ in self.split(self.normalise(text[at : m.start()]))]
            out.append(self.special[m[0]])
            at = m.end()
        return out + [p for p, _ in self.split(self.normalise(text[at:]))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        parts = [self.pieces(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set().union(*parts).difference(self.memo)
        self._learn([p for p in new if isinstance(p, str)])
        self.memo.update({i: np.int32(i).tobytes() for i in new if isinstance(i, int)})
        out = [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        for p in new:
            if isinstance(p, str) and len(p) > LONG:
                del self.memo[p]
        return out

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.first[data], np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        ids, counts = self.forest.merge(symbols, lengths)
        packed, to = ids.astype("<i4").tobytes(), 4 * np.cumsum(counts)
        self.memo.update(zip(pieces, map(packed.__getitem__, map(slice, (to - 4 * counts).tolist(), to.tolist()))))

    def decode(self, ids: pa.ListArray, skip_special: bool) -> pa.Array:
        """The tokens of each row of ids, joined by one space; ids without a token are left out."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        good = (flat >= 0) & (flat < len(self.tokens))
        good[good] = self.tokens.is_valid().to_numpy(zero_copy_only=False)[flat[good]]
        if skip_special:
            good &= ~np.isin(flat, list(self.special.values()))
        kept = np.concatenate([[0], np.cumsum(good)])[offsets - offsets[0]]
        rows = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), self.tokens.take(pa.array(flat[good])))
        return pc.binary_join(rows, " ")


def codec(path: str) -> Codec:
    if path not in _open:
        _open.clear()
        _open[path] = Codec(path)
    return _open[path]


def slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of a batch into runs of rows of about SLICE bytes."""
    run = (np.cumsum(sizes) // SLICE).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in itertools.pairwise(cuts) if b > a]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text), without begin, end or other added tokens.

    Special tokens that stand in a text get their ids. Null and empty texts have no ids; null ids of documents and repeated rows stay, a
    row each; other columns may have any names; an empty table gives none.
    """
    ship(docs.sparkSession)

    def work(batches):
        known = codec(path)
        for b in batches:
            texts = b.column(1)
            for at, to in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                ids = known.encode(texts.slice(at, to - at).to_pylist())
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
                rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), rows], names=["doc_id", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, skip_special_tokens: bool = False) -> DataFrame:
    """(doc_id, ids, text) of each row of ``rows`` (doc_id, ids): its tokens joined by one space.

    Null ids count as none, whose text is empty; ids that the file doesn't have are left out. Null ids of documents and repeated rows stay.
    """
    ship(rows.sparkSession)

    def work(batches):
        known = codec(path)
        for b in batches:
            ids = b.column(1)
            for at, to in slices(4 * pc.list_value_length(ids).to_numpy(zero_copy_only=False)):
                text = known.decode(ids.slice(at, to - at), skip_special_tokens)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), ids.slice(at, to - at), text], names=["doc_id", "ids", "text"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    clean = F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda i: i.isNotNull())
    return rows.select("doc_id", clean.alias("ids")).mapInArrow(work, f"doc_id {kind}, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, encoded and decoded; a null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
