"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted by cell (source, language, topic). The cells' token weights are raked to the target of each
margin in turn until all margins fit. A document's probability is its cell's raked weight over the cell's tokens, scaled
so that the expected sample has the wanted number of tokens; no probability exceeds 1, and what the full cells
cannot give is spread over the others.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraseg.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
ROUNDS, CHUNKS, TOLERANCE = 4, 10, 1e-6


def topic_of(text: Column) -> Column:
    """A coarse kind of text, from the marks it carries."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("***")) | F.contains(text, F.lit("%%%")), "noise")
        .when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("icensed")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.length(text) >= 8000, "long")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Targets ``(value, target)`` of each margin: its shares of tokens, raised to a power and scaled to 1."""
    out = {}
    for name, power in powers.items():
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))
        total = sums.agg(F.sum("target").alias("total"))
        out[name] = sums.join(F.broadcast(total)).select("value", (F.col("target") / F.col("total")).alias("target"))
    return out


def stated(spark: SparkSession, weights: dict[str | None, float]) -> DataFrame:
    """Targets ``(value, target)`` of a margin as they are given, scaled to 1."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError(f"Target weights must not be negative, and one at least positive: {weights}")
    rows = [(NONE if value is None else str(value), weight / total) for value, weight in weights.items()]
    return spark.createDataFrame(rows, "value string, target double")


def cell_counts(docs: DataFrame, margins: list[str]) -> DataFrame:
    """Tokens and documents by cell; ``docs`` has the margins and ``tokens``. Null values are a value of their own."""
    return docs.groupBy(*margins).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``weight``: shares of tokens fitted to the targets of every margin.

    Values without a target get none; targets of values without tokens are spread over the margin's other values. Cells
    without tokens get weight 0.
    """
    margins = list(targets)
    for name, target in targets.items():
        known = target.select(F.col("value").alias(name), F.col("target").cast("double").alias(f"{name}_target"))
        cells = cells.join(known, name, "left").fillna(0.0, [f"{name}_target"])
    cells = written(cells.withColumn("weight", F.greatest("tokens", F.lit(0)).cast("double")))
    # A margin's targets count only where it has tokens.
    for name in margins:
        there = cells.groupBy(name).agg(F.max(f"{name}_target").alias("t"), F.sum("weight").alias("w")).filter("w > 0").agg(F.sum("t")).first()[0]
        if there:
            cells = cells.withColumn(f"{name}_target", F.col(f"{name}_target") / F.lit(there))
    for _ in range(CHUNKS):
        for _ in range(ROUNDS):
            for name in margins:
                own = F.sum("weight").over(Window.partitionBy(name))
                cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"{name}_target"), own), F.lit(0.0)))
        cells = written(cells)
        error = 0.0
        for name in margins:
            fit = cells.groupBy(name).agg(F.abs(F.sum("weight") - F.max(f"{name}_target")).alias("e"))
            error = max(error, fit.agg(F.max("e")).first()[0] or 0.0)
        if error < TOLERANCE:
            break
    else:
        warnings.warn(f"The targets do not fit together: a margin is off by {error:.2g} of all tokens.", stacklevel=2)
    return cells.drop(*(f"{name}_target" for name in margins))


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``probability``: expected tokens are ``share`` of all, in proportion to ``weight`` where possible."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, ratio = 0.0, F.try_divide(F.col("weight"), F.col("tokens"))
    for _ in range(100):
        full = F.coalesce(ratio * F.lit(scale) >= 1, F.lit(False))
        taken, free = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        after = (share * total - taken) / free if free else scale
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), ratio * F.lit(scale)), F.lit(0.0)))


def mix(
    docs: DataFrame, powers: dict[str, float] | None = None, *, targets: dict[str, dict[str | None, float]] | None = None, share: float = 0.5,
    seed: int = 42, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``weight`` (of the cell), ``probability`` and ``sampled``.

    ``powers`` names margins (columns of ``docs``, or ``topic``) whose own shares of tokens, raised to a power, are the
    target; ``targets`` gives the target weights of a margin's values outright (any scale; values not named get none; None
    is the null value). Targets that no weights can meet together are fitted as far as possible, with a warning. A row is sampled
    when the hash of its id and the seed is below its probability, so repeated ids go together; rows with a null id are
    hashed by text. Null margin values are one value of their own; a null text has no tokens, and a row without tokens
    has probability 0 unless its cell is sampled as a whole. Columns of these names in ``docs`` are replaced.
    An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.drop("weight", "probability", "sampled").withColumn("tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    docs = docs.withColumn("topic", topic_of(text) if topic is None else topic)
    powers, targets = powers or {}, targets or {}
    if not powers and not targets or set(powers) & set(targets):
        raise ValueError("Every margin needs a power or targets, and not both.")
    keys = {f"__{name}": F.coalesce(F.col(name).cast("string"), F.lit(NONE)) for name in [*powers, *targets]}
    keyed = docs.withColumns(keys)
    cells = written(cell_counts(keyed, list(keys)))
    wanted = {**tempered(cells, {f"__{n}": p for n, p in powers.items()}), **{f"__{n}": stated(docs.sparkSession, t) for n, t in targets.items()}}
    cells = probabilities(rake(cells, wanted), share)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), text)), 11) / F.lit(float(1 << 53))
    chosen = keyed.join(written(cells.select(*keys, "weight", "probability")), list(keys))
    return chosen.withColumn("sampled", drawn < F.col("probability")).drop(*keys)
