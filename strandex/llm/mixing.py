"""Soft-membership mixing of sources to target weights [native].

A naive Bayes classifier over hashed words, fitted on the labelled table, predicts each document's posterior over
domains. Nonnegative rates of the documents are then fitted by least squares, so that the expected tokens of each
domain, the sum of rate * tokens * posterior, meet the targets; a weak pull to rate 1 settles what the targets leave
open. The rates are a function of posteriors and one multiplier for each domain, which Newton steps find: a pass over
the compact table of posteriors gives the few sums that a step needs, and no rate is ever gathered.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import forget, words, written

BUCKETS = 1 << 18  # word hashes; the model has a row for each that says anything, which bounds what is broadcast to 8 MB
SAMPLE = 20_000  # labelled documents that the classifier is fitted on, by hash of their id
ALPHA = 1024.0  # words of the corpus that are added to each domain's
CLEAR = 12.0  # standard deviations from what is expected of a word by chance, from which it says anything
STRENGTHS = tuple([0.0] + [2.0 ** (-k / 2) for k in range(16, -5, -1)])  # of the evidence, of which held-out labels choose one
PULL = 1e-3
ROUNDS = 30
MOST = 8.0  # copies of a document, at most: a domain that is nearly absent can't be had by repeating a few of its documents
BIN = 8192  # rows whose copies are drawn together
MISS = 0.02  # of its wanted share, beyond which a domain's share is logged as a warning

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Domain:
    """Name, the labelled rows that belong to it as SQL over the labelled table, and its target share of tokens."""

    name: str
    where: str
    weight: float


#: Production targets of the registered query.
DOMAINS = (
    Domain("clean", "quality = 1 AND toxic = 0", 0.90),
    Domain("toxic", "quality = 1 AND toxic = 1", 0.02),
    Domain("low", "quality = 0", 0.08),
)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, domains: tuple[Domain, ...] = DOMAINS, sample: int = SAMPLE) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...), what a word in a text says for each domain, and the log-priors.

    Words count once in a text. A domain's share of a word is smoothed toward the word's share of all labelled texts, and words whose number in
    the domain chance may explain say nothing, as thousands of them would outweigh the few that tell. A fifth of the
    labelled rows, by hash of their id, is left out of the counts; weights are multiplied by the number in STRENGTHS, and priors shifted,
    so that the labels of that fifth are likeliest: posteriors are as sure as they are right, and where words tell nothing
    they are the domains' shares.

    Labelled rows that fit no domain, or with a null id, are left out; of several rows for one id the first domain
    counts. Without any labelled row all domains are equally likely.
    """
    kind = F.coalesce(*(F.when(F.expr(d.where), F.lit(k)) for k, d in enumerate(domains)))
    known = labels.select("doc_id", kind.alias("k")).where("doc_id IS NOT NULL AND k IS NOT NULL").groupBy("doc_id").agg(F.min("k").alias("k"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0
    counts = texts.where(~aside).select("k", F.explode(_buckets(words(F.col("text")))).alias("bucket")).groupBy("bucket", "k").agg(F.count("*").alias("n"))
    size = len(domains)
    wide = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(size)))
    wide = written(wide, "buckets")
    total = wide.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(size))).first()
    rows = {r["k"]: r["n"] for r in chosen.groupBy("k").agg(F.count("*").alias("n")).collect()}
    prior = [math.log((rows.get(k, 0) + 1) / (sum(rows.values()) + size)) for k in range(size)]
    n = [F.col(f"n{k}") for k in range(size)]
    share = (sum(n[1:], n[0]) + 1) / F.lit(float(sum(total) + BUCKETS))
    expected = [share * float(total[k]) for k in range(size)]
    clear = [F.abs(n[k] - expected[k]) >= CLEAR * F.sqrt(expected[k] + 1) for k in range(size)]
    says = [F.when(clear[k], F.log((n[k] / share + ALPHA) / F.lit(float(total[k] + ALPHA)))).otherwise(0.0) for k in range(size)]
    model = written(wide.where(F.array_contains(F.array(*clear), True)).select("bucket", *(says[k].alias(f"w{k}") for k in range(size))), "model")
    told = _evidence(texts.where(aside), model, size, ("k",)).select("k", *(f"s{k}" for k in range(size))).collect()  # a fifth of `sample`, or so
    strength, shift = _calibrated(np.array([[r[f"s{k}"] for k in range(size)] for r in told]), np.array([r["k"] for r in told]), np.array(prior)) if told else (1.0, np.zeros(size))
    scaled = written(model.select("bucket", *((F.col(f"w{k}") * strength).alias(f"w{k}") for k in range(size))), "model")
    forget(wide, model)
    return scaled, (np.array(prior) + shift).tolist()


def _calibrated(evidence: np.ndarray, kinds: np.ndarray, prior: np.ndarray) -> tuple[float, np.ndarray]:
    """The strength, of STRENGTHS, and the shift of log-priors that make held-out labels likeliest."""
    best = (math.inf, 1.0, np.zeros(len(prior)))
    share = (np.bincount(kinds, minlength=len(prior)) + 10 * np.exp(prior)) / (len(kinds) + 10)
    for c in STRENGTHS:
        shift = np.zeros(len(prior))
        for _ in range(200):  # until each domain's mean posterior is its share
            logit = prior + shift + c * evidence
            post = np.exp(logit - np.logaddexp.reduce(logit, axis=1)[:, None])
            mean = (post.sum(0) + 10 * np.exp(prior)) / (len(kinds) + 10)
            shift += np.log(share / mean)
        loss = float((np.logaddexp.reduce(logit, axis=1) - logit[np.arange(len(kinds)), kinds]).mean())
        if loss < best[0] - 1e-9:
            best = (loss, c, shift)
    return best[1], best[2]


def _buckets(ws: Column) -> Column:
    return F.array_distinct(F.transform(ws, _bucket))


def _evidence(docs: DataFrame, model: DataFrame, size: int, keep: tuple[str, ...]) -> DataFrame:
    """row, `keep`, n_tokens and s0, s1, ...: what a text's words say for each domain, 0 without words.

    Distinct words are exploded and summed again by row, which the map side does before anything is shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, words(F.col("text")).alias("__sx_words"))
    each = rows.select("row", *keep, F.size("__sx_words").cast("long").alias("n_tokens"), F.explode_outer(_buckets(F.col("__sx_words"))).alias("bucket"))
    joined = each.join(F.broadcast(model), "bucket", "left")  # BUCKETS rows at most
    return joined.groupBy("row", *keep).agg(F.max("n_tokens").alias("n_tokens"), *(F.sum(F.coalesce(f"w{k}", F.lit(0.0))).alias(f"s{k}") for k in range(size)))


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens (words) and p0, p1, ... for each row of `docs`; a text without words has the priors."""
    size = len(prior)
    got = _evidence(docs, model, size, keep)
    logit = got.select("row", *keep, "n_tokens", *((F.lit(prior[k]) + F.col(f"s{k}")).alias(f"l{k}") for k in range(size)))
    top = F.greatest(*(F.col(f"l{k}") for k in range(size))) if size > 1 else F.col("l0")
    soft = logit.select("row", *keep, "n_tokens", *(F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(size)))
    norm = sum((F.col(f"e{k}") for k in range(1, size)), F.col("e0"))
    return soft.select("row", *keep, "n_tokens", *((F.col(f"e{k}") / norm).alias(f"p{k}") for k in range(size)))


def rates(post: DataFrame, weights: list[float], total: float | None = None, rounds: int = ROUNDS, pull: float = PULL, most: float = MOST, held: Column | None = None) -> tuple[Column, list[float]]:
    """The rate of a row of `post` as a column, and the expected share of each domain that it gives.

    Minimises the sum over domains of (share - target)^2 / present share, plus pull * the token-weighted mean of
    (rate - 1)^2, with rates from 0 to `most`, and 1 where `held`. The best rate is 1 + the sum of posterior * multiplier,
    cut to the bounds; the multipliers minimise a convex function, piecewise quadratic, by Newton steps that are halved
    until it falls. `total` is the tokens wanted, by default those there are. Shares are of that.
    """
    size = len(weights)
    first = post.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(f"p{k}")) for k in range(size))).first()
    tokens = float(first[0] or 0)
    if not tokens:
        return F.lit(1.0), [0.0] * size
    scale = (total or tokens) / tokens
    wanted = np.array([w / sum(weights) * scale for w in weights])
    there = np.array([max(float(x) / tokens, 1e-9) for x in first[1:]])
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))

    def rate(at: np.ndarray) -> tuple[Column, Column]:
        free = sum((F.lit(float(c)) * F.col(f"p{k}") for k, c in enumerate(at)), F.lit(1.0))
        return free, F.when(held, 1.0).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), free)))

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The function, its gradient and curvature, and the shares."""
        free, r = rate(at)
        n = F.col("n_tokens") / F.lit(tokens)
        inside = F.when(~held & (free > 0) & (free < most), n).otherwise(0.0)
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        value = F.when(held, free).otherwise(r * free - r * r / 2)
        row = post.agg(F.sum(n * value), *(F.sum(n * r * F.col(f"p{k}")) for k in range(size)), *(F.sum(inside * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs)).first()
        row = [float(x or 0) for x in row]
        share, bend = np.array(row[1 : size + 1]), np.diag(there * pull)
        for (i, j), x in zip(pairs, row[size + 1 :], strict=True):
            bend[i, j] += x
            bend[j, i] = bend[i, j]
        return row[0] + float(there * pull @ at**2) / 2 - float(wanted @ at), share - wanted + there * pull * at, bend, share

    at = np.zeros(size)
    value, slope, bend, share = sums(at)
    for _ in range(rounds):
        move = -np.linalg.solve(bend, slope)
        fall = float(slope @ move)
        if -fall < 1e-14 or np.abs(move).max() < 1e-7:
            break
        part = 1.0
        while (new := sums(at + part * move))[0] > value + 1e-4 * part * fall + 1e-15 and part > 1e-6:
            part /= 2
        at = at + part * move
        value, slope, bend, share = new
    else:
        log.warning("mixing: rates after %d rounds, not at their fixed point", rounds)
    return rate(at)[1], [float(s) / scale for s in share]


def copies(rated: DataFrame, size: int, keep: tuple[str, ...], seed: int = 17) -> DataFrame:
    """`rated` with `copies`, whole numbers with the rates as their means: the floor, and one more for some.

    Who gets one more is a systematic draw: rows are dealt into bins of about BIN by hash, put in order of their likeliest
    domain and tokens there, and get one where the running sum of what is left of the rates, from a start that the bin's
    hash draws, passes a whole number. So each bin's copies, and each domain's tokens in it, differ from what is
    expected by about one document. A bin is a task's work whatever the number of rows.
    """
    bins = max(1, rated.count() // BIN)
    top = F.greatest(*(F.col(f"p{k}") for k in range(size))) if size > 1 else F.col("p0")
    likeliest = F.coalesce(*(F.when(F.col(f"p{k}") == top, F.lit(k)) for k in range(size)))
    dealt = rated.withColumn("__sx_h", F.xxhash64(*keep, "row", F.lit(seed))).withColumn("__sx_bin", F.pmod("__sx_h", F.lit(bins)))
    dealt = dealt.withColumn("__sx_rest", F.col("rate") - F.floor("rate")).withColumn("__sx_top", likeliest)
    start = F.pmod(F.xxhash64("__sx_bin", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    w = Window.partitionBy("__sx_bin").orderBy("__sx_top", "n_tokens", "__sx_h", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__sx_to", F.sum("__sx_rest").over(w) + start)
    more = F.floor("__sx_to") - F.floor(F.col("__sx_to") - F.col("__sx_rest"))
    got = summed.withColumn("copies", (F.floor("rate") + F.least(F.greatest(more, F.lit(0)), F.lit(1))).cast("long"))
    return got.drop("__sx_h", "__sx_bin", "__sx_rest", "__sx_top", "__sx_to")


def shares(mixed: DataFrame, domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """(name, wanted, expected, delivered) of the rows of mix(): shares of tokens by weights, by rates and by whole copies."""
    total = sum(d.weight for d in domains)
    sums = [F.sum(F.col("n_tokens") * F.col(by) * F.col(f"p_{d.name}")).alias(f"{by}{k}") for k, d in enumerate(domains) for by in ("rate", "copies")]
    row = mixed.agg(F.sum(F.col("n_tokens") * F.col("rate")).alias("rate"), F.sum(F.col("n_tokens") * F.col("copies")).alias("copies"), *sums)
    each = F.array(*(F.struct(F.lit(d.name).alias("name"), F.lit(d.weight / total).alias("wanted"), (F.col(f"rate{k}") / F.col("rate")).alias("expected"), (F.col(f"copies{k}") / F.col("copies")).alias("delivered")) for k, d in enumerate(domains)))
    return row.select(F.inline(each))


def mix(docs: DataFrame, labels: DataFrame, domains: tuple[Domain, ...] = DOMAINS, total: float | None = None, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, at_present: tuple[str, ...] = (), most: float = MOST) -> DataFrame:
    """`keep`, n_tokens, a posterior p_<name> for each domain, rate and copies; a row for each row of `docs`.

    Domains in `at_present` are wanted with the tokens that they have, and take no part in the sharing out of `total`;
    rows whose likeliest domain is one of them keep the rate 1, and the rates of the others are fitted beside them.
    Shares that the bounds of the rates leave unmet are logged, and shares() tells them.

    Null, empty and blank texts have no tokens and the priors. Repeated rows and ids count each, and a null id stays null.
    A text of any length is exploded to its words and summed before anything is shuffled. Columns of `docs` other than `keep`
    and text, whatever their names, are ignored; empty tables give empty results.
    """
    model, prior = fit(docs, labels, domains, sample)
    post = written(posteriors(docs, model, prior, keep), "posteriors")
    weights = [d.weight for d in domains]
    held = None
    if at_present:
        top = F.greatest(*(F.col(f"p{k}") for k in range(len(domains)))) if len(domains) > 1 else F.col("p0")
        held = F.greatest(F.lit(-1.0), *(F.col(f"p{k}") for k, d in enumerate(domains) if d.name in at_present)) == top
        row = post.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in range(len(domains)))).first()
        fixed = sum(row[k] for k, d in enumerate(domains) if d.name in at_present)
        share = sum(d.weight for d in domains if d.name in at_present)
        total = fixed / share if share and fixed else total
        weights = [row[k] / total if d.name in at_present and total else d.weight for k, d in enumerate(domains)]
    rate, got = rates(post, weights, total, most=most, held=held)
    for d, want, share in zip(domains, weights, got, strict=True):
        want /= sum(weights)
        log.log(logging.WARNING if abs(share - want) > MISS * want else logging.INFO, "mixing: %s wanted %.5f of the tokens, gets %.5f", d.name, want, share)
    drawn = copies(post.withColumn("rate", rate), len(domains), keep)
    out = written(drawn.select(*keep, "n_tokens", *(F.col(f"p{k}").alias(f"p_{d.name}") for k, d in enumerate(domains)), "rate", "copies"), "mixed")
    forget(model, post)
    return out


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates and copies of all `documents` for the target weights of the domains of `labels`. Awkward rows: see mix."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
