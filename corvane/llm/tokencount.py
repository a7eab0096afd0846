"""Token counts through a digest cache.

A text's content digest and the tokenizer's version digest are looked up in a stored table of
counts; each distinct text that is not there is encoded once, and its count is appended to
the table. Copies within a partition are dropped before the shuffle by digest, so a text that
a third of all rows share costs one row a partition.

Where a tokenizer never joins characters across white space, as the one used by the query, the texts to
encode are cut there, and a bounded memo in each worker keeps the counts of pieces.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.runtime import materialise, scratch_dir, ship, table

LIMIT, MEMO = 2048, 400_000
_open: dict = {}
#: Python's split() takes these for white space, the tokenizers' library doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Counts tokens as the file's library does, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.pieces = False
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
            self.t.no_truncation()
            self.t.no_padding()
            self.pieces = _splits_at_space(json.load(open(path, encoding="utf-8")))
        else:
            import sentencepiece

            self.t = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(self, texts: list[str]) -> list[int]:
        if hasattr(self.t, "encode_batch"):
            return [len(e.ids) for e in self.t.encode_batch(texts, add_special_tokens=False)]
        return [len(e) for e in self.t.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        if not self.pieces or any(c in text for c in _NOT_SPACE):
            return self.whole([text])[0]
        memo, words = self.memo, text.split()
        new = list({w for w in words if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set(words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            memo.update(zip(part, self.whole(part)))
        n = sum(map(memo.__getitem__, words))
        if len(memo) > MEMO:
            memo.clear()
        return n


#: The pattern of the normaliser and that of the split after which no piece reaches over white space.
_SPACES, _PIECES = r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_space(spec: dict) -> bool:
    """Whether the file's normaliser and pre-tokeniser work on each piece between white space alone.

    True for NFC, white space to one space and lower-casing, then a split by the known pattern that drops white space;
    with added tokens that have no white space and take none beside them. Any other file's texts are encoded whole.
    """
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n.get("type") for n in norm] != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
        return False
    spaces = norm[1].get("pattern") == {"Regex": _SPACES} and norm[1].get("content") == " "
    drops = pre[0].get("pattern") == {"Regex": _PIECES} and pre[0].get("invert") is True and pre[0].get("behavior") == "Removed" and not pre[1].get("add_prefix_space")
    return spaces and drops and all(not (re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open.clear()
        _open[path] = Encoder(path)
    return _open[path]


def version(path: str) -> str:
    """Digest of the tokenizer's file."""
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def digest(text):
    """Content digest; null counts as empty. Nothing else is normalised, as counts may depend on it."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def encode_misses(docs: DataFrame, cache: DataFrame | None, path: str) -> DataFrame:
    """(digest, n_tokens) of each distinct text of ``docs`` that ``cache`` (digest) lacks. A null text counts as empty; no rows give none."""
    import zstandard

    ship(docs.sparkSession)

    def pack(batches):
        seen: set[bytes] = set()
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            keep = []
            for at, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    keep.append(at)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([z.compress(t.encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["digest", "packed"])

    def encode(batches):
        seen: set[bytes] = set()
        z = zstandard.ZstdDecompressor()
        count = encoder(path).count
        for b in batches:
            keys, counts = [], []
            for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    keys.append(d)
                    counts.append(count(z.decompress(p).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    texts = docs.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    packed = texts.mapInArrow(pack, "digest binary, packed binary")
    dealt = packed.repartition("digest") if cache is None else packed.join(cache.select("digest").hint("shuffle_hash"), "digest", "left_anti").repartition("digest")
    return dealt.mapInArrow(encode, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache_dir: str, increments: int = 2) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of ``docs``; the counts of new texts are appended to ``cache_dir``.

    The rows are looked up in ``increments`` by a hash of their ids, so that what one has appended the next one finds, and a lost run begins with what is stored. The
    cache is Parquet, partitioned by the tokenizer's version; it may be missing. An append that is
    lost halfway leaves no rows, as Spark commits files at the end. Null texts count as empty, null ids and repeated rows stay; other columns may have any names.
    """
    spark = docs.sparkSession
    tag = version(path)
    schema = "digest binary, n_tokens long, tokenizer string"

    def stored() -> DataFrame | None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{cache_dir}/_SUCCESS")
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return spark.read.schema(schema).parquet(cache_dir).where(F.col("tokenizer") == tag).select("digest", "n_tokens")

    for k in range(increments):
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == k)
        encode_misses(some, stored(), path).withColumn("tokenizer", F.lit(tag)).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)
    text = F.coalesce("text", F.lit(""))
    rows = materialise(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest(text).alias("digest")), "digests")
    held = rows.groupBy("digest").agg(F.count("*").alias("m"))
    known = materialise(held.join(stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest"), "known")
    return hot.join(rows, known, "digest", "m", rows.count()).select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; a null text has no bytes and the tokens of an empty one."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_dir(spark, "token-counts"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
