"""Mixing sources to target weights by soft membership.

1. *Classifier.*  Labelled rows name the domain of some documents.  A naive
   Bayes model over hashed words and a few shape words (symbol, repetition and
   line-length classes of the text) gives every document a posterior over the
   domains.  It is fitted from at most ``max_labelled`` labelled rows (the
   documented bound).  Only buckets with evidence reach the driver and the plan
   (a few hundred; BUCKETS bounds them).
2. *Rates.*  Each document gets a nonnegative rate, its expected number of
   copies.  With p the posteriors and n the tokens, the expected total of domain
   d is sum(rate * n * p_d).  From rates of 1, projected gradient steps lower
   the squared distance of the totals from their targets:

       rate = max(0, rate - sum_d m_d * p_d),   m = W * (totals - targets)

   which is the gradient scaled by 1/n (documents of equal posteriors keep
   equal rates) for residuals weighted by W, the inverse of the products
   sum(n * p_d * p_e) over the documents that are free to move (rate above 0).
   A step that does not lower the residual is halved.  Steps are repeated until
   every total is within ``TOLERANCE`` of its target.  A step is one
   aggregation over the narrow table of tokens and posteriors (totals and
   products); only these few numbers reach the driver, and the rates are an
   expression of the steps, never a collected table.  Targets that no rates
   reach, or that ``STEPS`` aggregations do not, are reported: a
   ``MixingResidual`` warning, and ``document_rates`` carries the largest
   relative miss as a column; the rates are the best that were found.
3. *Targets.*  The anchor domain keeps ``headroom`` times its own expected
   tokens; the other domains get what their weights imply beside it.  So the
   anchor's documents have rates of at least about 1, and the mix is reached by
   thinning out the rest.

The main path is DataFrame functions only.

A domain that no bucket speaks for cannot be told from the anchor: it has no
members (posterior 0) and no target.

Defined cases: a null or empty text has no tokens (its rate cannot change the
mix; it is kept as its posterior says); null labels are not used; without any
label every document is the anchor's; a domain without any mass is left out of the
targets; repeated rows, and texts with equal posteriors, get the same rate, and
repeated rows the same number of copies; a very long text is one row with
distinct buckets, however often its words repeat; labelled documents that the
bound cuts off are chosen by a hash, ties by id; an empty table gives an empty
result; other columns are passed through by ``resample`` and ignored by
``document_rates``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, labelled_sample, q, written

BUCKETS = 1 << 18
MAX_LABELLED = 20_000
PSEUDO = 1.0
MIN_COUNT = 5             # labelled documents that a bucket needs to count as evidence
MIN_RATIO = 3.0           # log ratio that a bucket needs besides
MIN_ERRORS = 5.0          # standard errors by which its share must differ from the domain's
CLEAN_SHARE = 0.005       # of the labelled anchor texts, which may lean to another domain
MARGIN = 3.0              # log odds by which the others must lean to the anchor
STEPS = 30
TOLERANCE = 1e-3
HEADROOM = 1.05
SEED = 23

#: Weights of the domains that ``label_domains`` names.
TARGETS = {"clean": 0.95, "toxic": 0.04, "junk": 0.01}
ANCHOR = "clean"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: junk, else toxic, else clean; rows without quality are left out."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), lambda w: w != "")


def _buckets(words: str, text: str) -> Column:
    """Distinct buckets of a text's words and shape words."""
    plain = F.col(text)
    for s in "#*$%&|<>!":
        plain = F.replace(plain, F.lit(s), F.lit(""))
    n = F.greatest(F.size(words), F.lit(1))
    level = lambda name, x: F.concat(F.lit(f"\x00{name}"), F.least(F.floor(x), F.lit(9)).cast("string"))
    shape = F.array(
        level("symbols", 5 * (F.octet_length(text) - F.octet_length(plain)) / n),
        level("distinct", 10 * F.size(F.array_distinct(words)) / n),
        level("letters", F.length(F.array_join(words, "")) / n),
    )
    return F.transform(F.concat(F.array_distinct(F.col(words)), shape),
                       lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _tokenised(docs: DataFrame, text_col: str, names: dict) -> DataFrame:
    """``docs`` with the word count and the buckets of each text."""
    with_words = docs.withColumn(names["words"], _words(q(text_col).cast("string")))
    with_text = with_words.withColumn(names["text"], F.coalesce(q(text_col).cast("string"), F.lit("")))
    return with_text.withColumn(names["buckets"], _buckets(names["words"], names["text"])).withColumn(
        names["tokens"], F.size(names["words"]).cast("long"))


def fit_posteriors(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str,
                   max_labelled: int = MAX_LABELLED, seed: int = SEED, anchor: str = ANCHOR) -> tuple[list[float], list[dict[int, float]]]:
    """(log prior, log ratio of the buckets with evidence) of each domain, from a bounded sample of labelled rows."""
    chosen = labelled_sample(domains, F.col("domain").isNotNull(), [F.min("domain").alias("domain")], max_labelled, seed)
    narrow = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"))
    inner = {"words": "_words", "text": "_text", "buckets": "_buckets", "tokens": "_tokens"}
    used = _tokenised(narrow.join(F.broadcast(chosen), "doc_id"), "text", inner).select("domain", "_buckets")
    totals = {r["domain"]: r["n"] for r in used.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = sum(totals.get(d, 0) for d in names)
    prior = [math.log((totals.get(d, 0) + 1) / (n_all + len(names))) for d in names]
    seen, counts = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0)), []
    for k, d in enumerate(names):
        mine, n = totals.get(d, 0), F.col(f"n{k}")
        share = mine / n_all if n_all else 0.0
        spread = F.sqrt(seen * F.lit(share * (1 - share)))
        ratio = F.log(((n + PSEUDO) / F.lit(mine + 2 * PSEUDO)) / ((seen - n + PSEUDO) / F.lit(n_all - mine + 2 * PSEUDO)))
        # weaker ones mostly tell long texts from short ones
        evidence = (seen >= MIN_COUNT) & (spread > 0) & (F.abs(n - seen * F.lit(share)) >= MIN_ERRORS * spread) & (
            F.abs(ratio) >= MIN_RATIO)
        counts.append(F.when(evidence, ratio).otherwise(0.0).alias(f"w{k}"))
    cells = used.select("domain", F.explode(F.array_distinct("_buckets")).alias("bucket")).groupBy("bucket").agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(names)]).select("bucket", *counts)
    weights: list[dict[int, float]] = [{} for _ in names]
    for r in cells.where(" OR ".join(f"w{k} <> 0" for k in range(len(names)))).collect():     # the buckets with evidence
        for k in range(len(names)):
            if r[f"w{k}"]:
                weights[k][r["bucket"]] = r[f"w{k}"]
    # offsets: all but CLEAN_SHARE of the labelled anchor texts must lean to the anchor, however long they are
    base = names.index(anchor) if anchor in names else 0
    sums = [_evidence(F.col("_buckets"), w) for w in weights]
    tails = used.where(F.col("domain") == names[base]).agg(*[
        F.percentile_approx(sums[k] - sums[base], 1 - CLEAN_SHARE, 10_000).alias(f"q{k}") for k in range(len(names))]).first()
    for k in range(len(names)):
        if k != base and not any(w > 0 for w in weights[k].values()):
            prior[k] = -math.inf
        elif k != base and tails[f"q{k}"] is not None:
            prior[k] = min(prior[k], prior[base] - tails[f"q{k}"] - MARGIN)
    return prior, weights


def _evidence(buckets: Column, weights: Mapping[int, float]) -> Column:
    """Sum of the weights of the buckets that have one: a hash set picks them, a small constant map weighs them."""
    if not weights:
        return F.lit(0.0)
    table = F.str_to_map(F.lit(",".join(f"{b}:{w:.6g}" for b, w in sorted(weights.items()))), F.lit(","), F.lit(":")).cast(
        "map<int,double>")
    hits = F.filter(buckets, lambda b: b.isin(sorted(weights)))
    return F.aggregate(hits, F.lit(0.0).cast("double"), lambda total, b: total + F.element_at(table, b))


def with_posteriors(docs: DataFrame, model: tuple, domains: list[str], text_col: str, names: dict) -> DataFrame:
    """``docs`` with token counts and one posterior column per domain."""
    prior, weights = model
    df = _tokenised(docs, text_col, names)
    keep = [q(c) for c in docs.columns] + [F.col(names["tokens"])]
    logits = [(F.lit(prior[k]) + _evidence(F.col(names["buckets"]), weights[k])).alias(names[d]) for k, d in enumerate(domains)]
    df = df.select(*keep, *logits)
    top = F.greatest(*[F.col(names[d]) for d in domains]) if len(domains) > 1 else F.col(names[domains[0]])
    df = df.select(*keep, *[F.exp(F.col(names[d]) - top).alias(names[d]) for d in domains])
    whole = sum((F.col(names[d]) for d in domains), F.lit(0.0))
    return df.select(*keep, *[(F.col(names[d]) / whole).alias(names[d]) for d in domains])


def targets_for(mass: Mapping[str, float], weights: Mapping[str, float], anchor: str, headroom: float) -> dict[str, float]:
    """Expected tokens per domain: the anchor's own times ``headroom``, the others' beside it by weight."""
    live = {d: w for d, w in weights.items() if mass.get(d) and w > 0}
    base = anchor if anchor in live else max(live, key=lambda d: mass[d], default=None)
    return {d: mass[base] * headroom * w / live[base] for d, w in live.items()} if base else {}


def rate_column(steps: Sequence[Mapping[str, float]], names: dict) -> Column:
    """Rates after the projected steps, from a document's posteriors."""
    rate = F.lit(1.0)
    for m in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(x) * F.col(names[d]) for d, x in m.items()), F.lit(0.0)))
    return rate


class MixingResidual(UserWarning):
    """Totals that are not within the tolerance of their targets."""


def fit_rates(posteriors: DataFrame, weights: Mapping[str, float], anchor: str, headroom: float, names: dict,
              steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """(projected steps, targets, largest relative miss); each step is one aggregation to a few numbers per domain."""
    tokens, p = F.col(names["tokens"]), {d: F.col(names[d]) for d in weights}

    def sums(**columns: Column) -> dict[str, float]:
        row = posteriors.agg(*[F.sum(c).alias(k) for k, c in columns.items()]).first()
        return {k: float(row[k] or 0.0) for k in columns}

    mass = sums(**{f"d{k}": tokens * p[d] for k, d in enumerate(weights)})
    targets = targets_for({d: mass[f"d{k}"] for k, d in enumerate(weights)}, weights, anchor, headroom)
    if not targets:
        return [], {}, 0.0
    domains, target = list(targets), np.array(list(targets.values()))
    pairs = [(i, j) for i in range(len(domains)) for j in range(i, len(domains))]

    def at(taken: list) -> tuple[np.ndarray, np.ndarray]:
        """Totals, and the products of posteriors over the free documents."""
        rate = rate_column([dict(zip(domains, m.tolist())) for m in taken], names)
        free = F.when(rate > 0, tokens).otherwise(0)
        row = sums(**{f"t{i}": rate * tokens * p[d] for i, d in enumerate(domains)},
                   **{f"g{i}_{j}": free * p[domains[i]] * p[domains[j]] for i, j in pairs})
        gram = np.zeros((len(domains), len(domains)))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
        return np.array([row[f"t{i}"] for i in range(len(domains))]), gram

    miss = lambda totals: float(np.abs(totals / target - 1).max())
    taken: list[np.ndarray] = []
    now, gram = at(taken)
    size, best = 1.0, (miss(now), [])
    for _ in range(steps):
        if best[0] <= tolerance:
            break
        weigh = np.linalg.inv(gram + 1e-9 * np.diag(np.maximum(np.diag(gram), target)))
        found = at([*taken, size * weigh @ (now - target)])
        if np.linalg.norm(found[0] / target - 1) < np.linalg.norm(now / target - 1) or size < 1 / 64:
            taken, (now, gram), size = [*taken, size * weigh @ (now - target)], found, 1.0
            best = min(best, (miss(now), taken), key=lambda b: b[0])
        else:
            size /= 2
    if best[0] > tolerance:
        warnings.warn(f"mixing totals miss their targets by up to {best[0]:.3g} after {steps} steps", MixingResidual, stacklevel=2)
    return [dict(zip(domains, m.tolist())) for m in best[1]], targets, best[0]


def _names(columns: list[str], domains: list[str]) -> dict:
    names: dict[str, str] = {}
    for base in ("words", "text", "buckets", "tokens", "rate", *domains):
        names[base] = fresh(columns + list(names.values()), f"_{base}")
    return names


def _rated(docs: DataFrame, domains: DataFrame, weights: Mapping[str, float], anchor: str, headroom: float, id_col: str,
           text_col: str, max_labelled: int, label: str) -> tuple[DataFrame, dict]:
    names = _names(docs.columns, list(weights))
    model = fit_posteriors(docs, domains, list(weights), id_col, text_col, max_labelled, anchor=anchor)
    table = written(with_posteriors(docs, model, list(weights), text_col, names), label)
    narrow = table.select(names["tokens"], *[names[d] for d in weights])
    steps, _, _ = fit_rates(narrow, weights, anchor, headroom, names)
    return table.withColumn(names["rate"], rate_column(steps, names)), names


def document_rates(docs: DataFrame, domains: DataFrame, weights: Mapping[str, float] = TARGETS, anchor: str = ANCHOR,
                   headroom: float = HEADROOM, id_col: str = "doc_id", text_col: str = "text",
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>, rate, copies, miss (largest relative miss of a target)."""
    narrow = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"))
    slim = _names(narrow.columns, list(weights))
    model = fit_posteriors(narrow, domains, list(weights), "doc_id", "text", max_labelled, anchor=anchor)
    scored = with_posteriors(narrow, model, list(weights), "text", slim)
    digest = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text"))
    table = written(scored.withColumn("_draw", digest).drop("text"), "mixing_rates")
    steps, _, miss = fit_rates(table, weights, anchor, headroom, slim)
    rated = table.withColumn("rate", rate_column(steps, slim))
    return rated.select("doc_id", F.col(slim["tokens"]).alias("n_tokens"), *[F.col(slim[d]).alias(f"p_{d}") for d in weights],
                        "rate", copies(F.col("rate"), F.col("_draw")).alias("copies"), F.lit(miss).alias("miss"))


def copies(rate: Column, draw: Column) -> Column:
    """Whole copies whose expectation is the rate: a seeded hash decides on the fraction."""
    unit = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, domains: DataFrame, weights: Mapping[str, float] = TARGETS, anchor: str = ANCHOR,
             headroom: float = HEADROOM, id_col: str = "doc_id", text_col: str = "text",
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The mixed corpus: each document as often as its number of copies, with the columns it came with."""
    rated, names = _rated(docs, domains, weights, anchor, headroom, id_col, text_col, max_labelled, "mixing_documents")
    draw = F.xxhash64(F.lit(SEED), q(id_col), q(text_col))
    again = fresh(rated.columns, "_copy")
    return rated.withColumn(again, F.explode(F.array_repeat(F.lit(1), copies(F.col(names["rate"]), draw)))).select(
        *[q(c) for c in docs.columns])
