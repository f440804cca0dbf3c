"""Corpus BLEU and chrF from summed n-gram counts, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraseg import __version__
from paraseg.functions.ngrams import CHAR_ORDER, WORD_ORDER

BETA = 2


def bleu(stats: str) -> Column:
    """BLEU (0-100) of the summed word counts in struct column ``stats``.

    Exponential smoothing: an order without a match counts as half a match, the
    next one as a quarter, and so on. A corpus without any n-gram of some order
    scores 0.
    """
    orders = range(1, WORD_ORDER + 1)
    match = {n: F.col(f"{stats}.match_{n}").cast("double") for n in orders}
    total = {n: F.col(f"{stats}.cand_{n}").cast("double") for n in orders}
    ref_len = F.col(f"{stats}.ref_1").cast("double")

    logs = []
    for n in orders:
        empty_orders = reduce(add, [F.when(match[k] == 0, 1).otherwise(0) for k in range(1, n + 1)])
        hits = F.when(match[n] == 0, 1 / F.pow(F.lit(2.0), empty_orders)).otherwise(match[n])
        logs.append(F.log(100 * hits / F.nullif(total[n], F.lit(0.0))))
    brevity = F.when(total[1] >= ref_len, F.lit(1.0)).otherwise(
        F.exp(1 - ref_len / F.nullif(total[1], F.lit(0.0)))
    )
    has_match = reduce(or_, [match[n] > 0 for n in orders])
    has_orders = reduce(and_, [total[n] > 0 for n in orders])
    return F.when(
        has_match & has_orders, brevity * F.exp(reduce(add, logs) / WORD_ORDER)
    ).otherwise(F.lit(0.0))


def bleu_signature() -> Column:
    return F.lit(f"nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp|version:{__version__}")


def chrf(stats: str) -> Column:
    """chrF (0-100) of the summed character counts in struct column ``stats``.

    Precision and recall are averaged over the orders both sides have.
    """
    zero = F.lit(0.0)
    used, precisions, recalls = [], [], []
    for n in range(1, CHAR_ORDER + 1):
        match, cand, ref = (
            F.col(f"{stats}.{part}_{n}").cast("double") for part in ("match", "cand", "ref")
        )
        both = (cand > 0) & (ref > 0)
        used.append(F.when(both, 1.0).otherwise(zero))
        precisions.append(F.when(both, match / F.nullif(cand, zero)).otherwise(zero))
        recalls.append(F.when(both, match / F.nullif(ref, zero)).otherwise(zero))
    orders = F.nullif(reduce(add, used), zero)
    precision, recall = reduce(add, precisions) / orders, reduce(add, recalls) / orders
    weight = BETA**2
    score = 100 * (1 + weight) * precision * recall / F.nullif(weight * precision + recall, zero)
    return F.coalesce(score, zero)
