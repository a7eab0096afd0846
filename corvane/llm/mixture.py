"""Soft-membership mixing with built-in functions only.

A classifier learned from the labelled table gives every document posterior probabilities of
its domains, from its words and from a few traits of the whole text. Nonnegative document rates are then fitted by projected gradient so that the
expected tokens of the domains match target weights. A rate depends on the posterior alone, in steps of a hundredth (a thousandth
near zero), so documents fall into a bounded number of cells. Spark sums each cell's tokens and expected tokens, from exact
posteriors; the descent runs over these sums until it has met the targets or can't come nearer; the rates go back to the documents by cell.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.text import ascii_lower
from corvane.runtime import materialise, table

BUCKETS = 131_072
#: A word of symbols alone.
BARE = r"(?<![^ \t-\r])[!-/:-@\[-`{-~]+(?![^ \t-\r])"
#: The classifier learns from about so many labelled documents at most, chosen by a hash of the id.
SAMPLE = 20_000
PRIOR_DOCS, PRIOR_COUNT, LEAST_Z, LEAST_RATIO, TOLERANCE, STALL = 50.0, 5000.0, 5.0, 4.0, 1e-5, 1e-10
#: For a domain that is told by the make-up of whole texts, words weigh in full in texts of up to so many distinct ones;
#: in longer texts their mean counts as that of so many, or a long text's words would outweigh every trait.
FULL_WEIGHT = 200
#: Domains of the labelled table and the shares of tokens that they are to have.
DOMAINS, TARGETS = ("clean", "toxic", "poor"), (0.96, 0.01, 0.03)
#: The domain that the make-up of texts tells.
POOR = 2
#: The same for texts from which a quality classifier has taken the poor ones.
GOOD_TARGETS = (0.99, 0.01)


def domain_of() -> Column:
    return F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and the like) with w, the words of the text, b, their distinct buckets, and m, the buckets of traits of the whole text.

    Traits begin with a space, which no word has: how varied, how long and how many the words are, and the shares of digits,
    capitals, symbols, short words and words of symbols alone, each in steps, and four pairs of them."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", _words(F.col("text")))
    n, chars = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.char_length("text"), F.lit(1))
    share = lambda kind: F.floor(-F.log2(F.regexp_count("text", F.lit(f"[{kind}]")) / chars + 1e-4) * 2)
    told = {
        "varied": F.floor(20 * F.size(F.array_distinct("w")) / n), "long": F.floor(2 * chars / n), "digits": share("0-9"), "capitals": share("A-Z"),
        "symbols": share(r"!#-&*+/<=>@\[-`{-~"), "short": F.floor(20 * F.size(F.filter("w", lambda x: F.char_length(x) <= 3)) / n), "words": F.floor(F.log2(n.cast("double"))),
        "bars": F.floor(-F.log2(F.regexp_count("text", F.lit(BARE)) / n + 1e-3) * 2),
    }
    rows = rows.withColumns({k: v.cast("string") for k, v in told.items()})
    traits = [("varied",), ("long",), ("digits",), ("capitals",), ("symbols",), ("short",), ("words",), ("bars",), ("varied", "words"), ("symbols", "long"), ("short", "long"), ("bars", "words")]
    marks = F.array(*(F.concat_ws(" ", F.lit(""), F.lit("+".join(t)), *t) for t in traits))
    marks = F.when(F.size("w") > 0, marks).otherwise(F.array(F.lit(" none")))
    return rows.withColumns({"b": F.array_distinct(F.transform("w", _bucket)), "m": F.transform(marks, _bucket)}).drop(*told)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, domains: DataFrame, k: int, sample: int = SAMPLE) -> tuple[list[float], list[float], dict[int, list[float]]]:
    """Log priors, and log ratios to the overall share: of words that tell nothing, and of telling word buckets.

    Ids are those of ``docs``; null ones and null domains teach nothing, and of an id with several domains the least counts. A bucket tells if its share of documents differs between domains. Words are counted once for a document, so that one
    that repeats itself weighs no more than others; the many words that tell nothing are counted together, which weighs
    the evidence of the others against a text's length.
    ``domains``: doc_id, domain (int from 0). Only buckets x domains counts reach the driver.
    """
    known = domains.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))
    priors = [0] * k
    for d, c in docs.select("doc_id").join(F.broadcast(few), "doc_id").groupBy("domain").count().collect():
        priors[d] = c
    rows = _marked(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")).select("domain", F.explode_outer(F.array_union("b", "m")).alias("b"))  # no m is empty; a filter on it would compute it again
    counts = [[0] * BUCKETS for _ in range(k)]
    for d, b, c in rows.groupBy("domain", "b").count().collect():
        counts[d][b] = c
    whole, held = sum(priors), [sum(c) for c in counts]
    told = {b: [c[b] for c in counts] for b in range(BUCKETS) if _tells([c[b] for c in counts], priors)}
    rest = [h - sum(c[d] for c in told.values()) for d, h in enumerate(held)]

    def ratios(found: list[int]) -> list[float]:
        p = sum(found) / sum(held) if sum(found) else 1.0
        return [math.log((c + PRIOR_COUNT * p) / (h + PRIOR_COUNT) / p) for c, h in zip(found, held)]

    # a domain without labelled documents gets no posterior
    return [math.log(c / whole) if c else -1000.0 for c in priors], ratios(rest), {b: ratios(c) for b, c in told.items()}


def _tells(found: list[int], priors: list[int]) -> bool:
    """Whether documents with a bucket (``found``, by domain) are far from its overall share in any domain, and frequent in one."""
    if not any(found):
        return False
    p = sum(found) / sum(priors)
    z = max(abs(c - t * p) / math.sqrt(t * p * (1 - p) + 1) for c, t in zip(found, priors))
    most = max((c + PRIOR_DOCS * p) / (t + PRIOR_DOCS) / p for c, t in zip(found, priors))
    return z >= LEAST_Z and most >= LEAST_RATIO


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _adder(weights: Column):
    return lambda a, i: a + F.get(weights, i)


def _softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(F.greatest(s - F.array_max(scores), F.lit(-50.0))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def posteriors(docs: DataFrame, priors: list[float], rest: list[float], ratios: dict[int, list[float]], made_up: int | None = None) -> DataFrame:
    """(doc_id, row, n_tokens, posterior) for each row of ``docs``: a hash of the text, its words, and the domains' posteriors.

    Where ``made_up`` names a domain that the make-up of texts tells, its posterior is that of scores in which the words of a text of more than
    ``FULL_WEIGHT`` distinct ones all count, each for less; the other domains share what it leaves as their full scores say.

    Null and empty texts have no words and what the trait of having none tells; repeated rows stay."""
    place = [0] * BUCKETS
    for at, b in enumerate(sorted(ratios), 1):
        place[b] = at
    where = _literal(place, "int")
    rows = _marked(docs.select("doc_id", F.xxhash64("text").alias("row"), "text")).withColumn("n_tokens", F.size("w").cast("long"))
    told = lambda buckets: F.filter(F.transform(buckets, lambda b: F.get(where, b)), lambda i: i > 0)
    rows = rows.withColumns({"i": told("b"), "j": told("m")})
    others = (F.size("b") - F.size("i")).cast("double")
    scale = F.least(F.lit(1.0), FULL_WEIGHT / F.greatest(F.size("b"), F.lit(1)))
    sums, scaled = [], []
    for d, prior in enumerate(priors):
        w = _literal([0.0, *(round(ratios[b][d], 6) for b in sorted(ratios))], "double")
        rows = rows.withColumn(f"words{d}", F.aggregate("i", others * F.lit(round(rest[d], 9)), _adder(w)))
        for found, weight in ((sums, F.lit(1.0)), (scaled, scale)):
            found.append(F.aggregate("j", F.lit(float(prior)) + weight * F.col(f"words{d}"), _adder(w)))
    rows = rows.withColumns({"full": F.array(*sums), "scaled": F.array(*scaled)})
    if made_up is None:
        return rows.select("doc_id", "row", "n_tokens", _softmax(F.col("full")).alias("posterior"))
    without = F.transform("full", lambda s, d: F.when(d == made_up, F.lit(float("-inf"))).otherwise(s))
    rows = rows.withColumns({"others": _softmax(without), "its": F.get(_softmax(F.col("scaled")), F.lit(made_up))})
    shared = F.transform("others", lambda p, d: F.when(d == made_up, F.col("its")).otherwise(p * (1 - F.col("its"))))
    return rows.select("doc_id", "row", "n_tokens", shared.alias("posterior"))


def cell_of(posterior: Column) -> Column:
    """The cell of a posterior: its parts in hundredths, and in thousandths below 0.05, as text."""
    step = F.transform(posterior, lambda p: F.when(p < 0.05, F.round(p * 1000)).otherwise(F.round(p * 100) + 100).cast("int").cast("string"))
    return F.array_join(step, ",")


def fit(mass: np.ndarray, tokens: np.ndarray, targets: list[float], most: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates by cell, and the relative errors that are left by domain.

    ``mass`` [cells, domains] are expected tokens and ``tokens`` [cells] all tokens. Projected gradient minimises the squared errors of the domains' expected tokens, in
    relation to what there are, with momentum. The budget is such that the domain of the largest target keeps its tokens as they are. A domain without
    tokens can't be matched and is left out; one that falls short even at the largest rate stays there, and its error tells so.
    """
    rates, k = np.full(len(mass), min(1.0, most)), len(targets)
    have = mass.T @ rates
    live = [j for j in range(k) if have[j] > 0 and targets[j] > 0]
    if not live:
        return rates, np.zeros(k)
    share = sum(targets[j] for j in live)
    main = max(live, key=lambda j: (targets[j], -j))
    goal = np.array([targets[j] / share * have[main] / (targets[main] / share) if j in live else 0.0 for j in range(k)])
    p = mass / np.maximum(tokens, 1e-9)[:, None]
    size, aim = np.where(have > 0, have, 1.0), np.where(goal > 0, goal, np.where(have > 0, have, 1.0))
    ahead, pace, best, quiet = rates, 1.0, math.inf, 0
    while quiet < 500:  # steps that no longer gain anything
        new = np.clip(ahead - p @ ((mass.T @ ahead - goal) / size), 0, most)
        left = mass.T @ new - goal
        loss = float((left * left / size).sum())
        quiet = quiet + 1 if loss >= best * (1 - 1e-9) else 0
        best = min(best, loss)
        met = np.abs(left / aim).max() < TOLERANCE or np.abs(new - ahead).max() < STALL
        if (ahead - new) @ (new - rates) > 0:  # momentum that leads back begins anew
            ahead, pace = new, 1.0
        else:
            pace, before = (1 + math.sqrt(1 + 4 * pace * pace)) / 2, pace
            ahead = new + (before - 1) / pace * (new - rates)
        rates = new
        if met:
            break
    return rates, (mass.T @ rates - goal) / aim


def mix(docs: DataFrame, domains: DataFrame, targets: tuple = TARGETS, most: float = 1.0, made_up: int | None = None) -> DataFrame:
    """For each row doc_id, row (xxhash64 of the text), n_tokens, posterior (array), rate and copies (rate rounded up or down by a hash of id and text).

    Null and empty texts have no tokens; null ids hash like others, texts under one id are told apart, and
    repeated rows share their rate and copies. ``made_up``: see :func:`posteriors`. Warns where a target is missed by over a hundredth of it. An empty table gives no rows; other columns may have any names.
    """
    k = len(targets)
    rows = materialise(posteriors(docs.select("doc_id", "text"), *classifier(docs, domains, k), made_up), "posteriors")
    rows = rows.withColumn("cell", cell_of(F.col("posterior")))
    sums = rows.groupBy("cell").agg(F.sum("n_tokens").cast("double"), *(F.sum(F.get("posterior", F.lit(j)) * F.col("n_tokens")) for j in range(k))).collect()
    sums = sorted(map(tuple, sums))  # as many as the posterior has steps, whatever the corpus
    flat = np.array([s[1:] for s in sums], np.float64).reshape(len(sums), k + 1)
    rates, errors = fit(flat[:, 1:], flat[:, 0], list(targets), most)
    if np.abs(errors).max(initial=0) > 0.01:
        warnings.warn(f"the rates can't meet the targets: relative errors by domain {np.round(errors, 4).tolist()}", stacklevel=2)
    spark = docs.sparkSession
    told = spark.createDataFrame([(s[0], float(r)) for s, r in zip(sums, rates)] or [("", 0.0)], "cell string, rate double")
    spread = F.pmod(F.xxhash64("doc_id", "row", F.lit("copies")), F.lit(1_000_000)) / 1e6
    out = rows.join(F.broadcast(told), "cell").withColumn("copies", F.floor(F.col("rate") + spread).cast("long"))
    return out.select("doc_id", "row", "n_tokens", "posterior", "rate", "copies")


def mixed(docs: DataFrame, domains: DataFrame, targets: tuple = TARGETS, most: float = 1.0) -> DataFrame:
    """``docs`` with each row repeated as often as its copies say (with ``most`` 1: kept or left out), and all columns, whatever their names.

    A row is known by its id, which may be null, and its text; repeated rows share their fate."""
    told = materialise(mix(docs, domains, targets, most).select("doc_id", "row", "copies").where("copies <> 1").distinct(), "copies")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.struct("*").alias("all"))
    same = lambda some: rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["row"] == some["row"])
    if most <= 1:
        return rows.join(told, same(told), "left_anti").select("all.*")
    times = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))
    return rows.join(told, same(told), "left").where("copies is null or copies > 0").withColumn("time", times).select("all.*")


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): rows without a label of quality are left out."""
    return labels.where("quality is not null").select("doc_id", domain_of().alias("domain"))


def labelled_good(labels: DataFrame) -> DataFrame:
    """Domains of texts that passed a quality classifier: 0 clean, 1 toxic."""
    return labels.where("toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, as :func:`mix` defines it for nulls, empty texts and repeated rows."""
    out = mix(table(spark, sf_dir, "documents"), labelled(table(spark, sf_dir, "labels")), most=4.0, made_up=POOR)
    return out.select(
        "doc_id", "n_tokens", *(F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"), "copies",
    )
