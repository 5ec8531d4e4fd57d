"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). The cells are raked: scaled in turn to each
marginal's targets until all fit. A cell's weight is its raked share over its own; documents are then
sampled with calibrated probabilities. The draw is a hash of the doc_id, so it is the same wherever and however often a
row is computed, and copies of a doc_id share their fate.

No probability can exceed 1, so a target may ask for more tokens than there are. Two answers are offered:

* ``calibrated``: the bound is part of the fit. Probabilities are scaled in turn, each capped at 1, until the tokens
  they keep meet every target; if some value lacks the tokens for its share of the budget, the whole budget is lowered
  until the targets can be met. The targets hold, ``keep`` is an upper limit. A weight is the probability over the
  share of tokens that is kept.
* otherwise the probability is ``min(1, c * weight)``, where ``c`` makes the expected tokens meet the budget exactly; the
  targets give way where the cap bites.

Up to ``MOST_CELLS`` cells are raked on the driver; more are raked by Spark aggregates and joins, by the same steps to the same
tolerance. Null values of a marginal are a value of their own. Rows without a doc_id are drawn by their text. A text
without words counts no tokens and follows its cell; a cell without tokens keeps weight 1.
Languages that the targets don't list, null too, keep the share of tokens that they have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MARGINALS = ("source", "lang", "topic")
#: Cells that the driver rakes, rounds at most, and the largest relative error of a marginal that ends them.
MOST_CELLS, ROUNDS, FIT = 200_000, 200, 1e-9
#: With the bound inside the fit: rounds before a budget counts as too large, the largest absolute error of a marginal's share, and what is tried next.
BOUNDED_ROUNDS, BOUNDED_FIT, LOWER = 2_000, 1e-6, 0.97
SEED = 20
#: Given shares that leave less than this leave nothing.
NO_REST = 1e-9


def _own(rest: float, whole: float, given: float) -> float:
    """What is to be added to the shares given so that the rest has its part of the whole tokens."""
    return given * rest / (whole - rest)


@dataclass(frozen=True)
class Shares:
    """Targets of a marginal: given shares for some values; the others split the rest as their tokens to the power ``temper``.

    If the given shares leave no rest, the others keep the share of tokens that they have, and the given ones are scaled down.
    """

    given: tuple[tuple[str, float], ...] = ()
    temper: float = 1.0

    def of(self, tokens: dict) -> dict:
        """A share for each value that has tokens, 1 in all."""
        given = {v: s for v, s in self.given if v in tokens}
        rest = {v: n**self.temper for v, n in tokens.items() if v not in given}
        left = max(0.0, 1 - sum(given.values())) if rest else 0.0
        if rest and left < NO_REST:
            left = _own(sum(tokens[v] for v in rest), sum(tokens.values()), sum(given.values()))
        total = sum(rest.values())
        out = given | {v: left * x / total for v, x in rest.items()}
        whole = sum(out.values())
        return {v: s / whole for v, s in out.items()} if whole else {v: 1 / len(tokens) for v in tokens}


#: What the query and the pipeline aim at: sources and topics flattened, languages as given; and the share of all tokens to keep.
TARGETS = {"source": Shares(temper=0.5), "lang": Shares((("en", 0.55), ("fr", 0.15), ("de", 0.15), ("es", 0.15))), "topic": Shares(temper=0.75)}
KEEP = 0.7


def topic(text: Column) -> Column:
    """A rough topic by what marks a text."""
    return (
        F.when(text.contains("icensed under") | text.contains(" License"), "legal")
        .when(text.contains(" | "), "tables")
        .when(text.contains("@"), "contact")
        .when(text.contains("!!") | text.contains("###") | text.contains("***"), "noise")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"\S+"))).cast("long")


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text, F.lit(SEED))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return docs.withColumn("topic", topic(text)).withColumn("n_tokens", tokens(text)).withColumn("draw", draw)


def rake(sums: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, fit: float = FIT) -> np.ndarray:
    """Shares of the cells whose marginals are the targets, as near as the empty cells let them be."""
    x = sums / sums.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, x, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target)[now > 0].max(initial=0)))
            x = x * factor[code]
        x /= x.sum() or 1.0
        if worst < fit:
            break
    return x


def scale(weight: np.ndarray, sums: np.ndarray, keep: float) -> float:
    """The factor c with which probabilities min(1, c * weight) keep the share ``keep`` of the tokens."""
    some = (weight > 0) & (sums > 0)
    weight, sums = weight[some], sums[some]
    goal = min(keep * sums.sum(), sums.sum())
    order = np.argsort(-weight)
    weight, sums = weight[order], sums[order]
    full = np.concatenate(([0.0], np.cumsum(sums)))
    rest = np.concatenate((np.cumsum((weight * sums)[::-1])[::-1], [0.0]))
    for i in range(len(weight)):  # the i heaviest cells are kept whole
        c = (goal - full[i]) / rest[i]
        if c * weight[i] <= 1 + 1e-12:
            return float(c)
    return float(1 / weight.min()) if len(weight) else 1.0


def bounded(sums: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = BOUNDED_ROUNDS, fit: float = BOUNDED_FIT) -> tuple[np.ndarray, float]:
    """Probabilities up to 1 whose tokens have the targets' shares, and the share of all tokens that they keep, ``keep`` at most.

    Where cells without tokens leave no way to meet the targets, the marginals come as near as raking does.
    """
    share = sums / sums.sum()
    have = [np.bincount(c, share, len(t)) for c, t in zip(codes, targets, strict=True)]
    # no value can give more than it has
    keep = min([keep, *(float((h[t > 0] / t[t > 0]).min()) for h, t in zip(have, targets, strict=True))])
    while True:
        x = np.full(len(sums), keep)
        worst = np.inf
        for _ in range(rounds):
            worst = 0.0
            for code, target in zip(codes, targets, strict=True):
                now = np.bincount(code, np.minimum(x, 1) * share, len(target))
                worst = max(worst, float(np.abs(now - keep * target).max()))
                factor = np.divide(keep * target, now, out=np.zeros_like(target), where=now > 0)
                x = x * factor[code]
            if worst < fit * keep:
                break
        if worst < fit * keep or x.max() <= 1:
            return np.minimum(x, 1), keep
        keep *= LOWER


def cell_weights(docs: DataFrame, targets: dict[str, Shares] = TARGETS, keep: float = KEEP, most: int = MOST_CELLS, calibrated: bool = False) -> DataFrame:
    """(source, lang, topic, weight, probability) of each cell of ``docs``, which has topic and n_tokens."""
    cells = cut(docs.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n")))
    if cells.count() > most:
        return _raked_by_spark(cells, targets, keep, calibrated=calibrated)
    rows = cells.orderBy(*MARGINALS).collect()
    spark = docs.sparkSession
    schema = ", ".join(f"{m} string" for m in MARGINALS) + ", weight double, probability double"
    sums = np.array([float(r.n or 0) for r in rows])
    if not sums.sum():
        return spark.createDataFrame([(*r[:3], 1.0, 1.0) for r in rows], schema)
    codes, goals = [], []
    for i, m in enumerate(MARGINALS):
        total: dict = {}
        for r, n in zip(rows, sums, strict=True):
            total[r[i]] = total.get(r[i], 0.0) + n
        share = targets.get(m, Shares()).of({v: n for v, n in total.items() if n})
        values = sorted(total, key=lambda v: (v is not None, v or ""))
        at = {v: j for j, v in enumerate(values)}
        codes.append(np.array([at[r[i]] for r in rows]))
        goals.append(np.array([share.get(v, 0.0) for v in values]))
    if calibrated:
        p, kept = bounded(sums, codes, goals, keep)
        p = np.where(sums > 0, p, kept)
        weight = p / kept if kept else np.ones_like(p)
    else:
        raked = rake(sums, codes, goals)
        weight = np.divide(raked * sums.sum(), sums, out=np.ones_like(sums), where=sums > 0)
        p = np.minimum(1.0, scale(weight, sums, keep) * weight)
    return spark.createDataFrame([(*r[:3], float(w), float(q)) for r, w, q in zip(rows, weight, p, strict=True)], schema)


def _goals(cells: DataFrame, m: str, t: Shares) -> DataFrame:
    """(value, goal, has) of a marginal: its target share, and the share of tokens that it has."""
    given = F.coalesce(*[F.when(F.col(m) == v, F.lit(float(s))) for v, s in t.given], F.lit(None).cast("double")) if t.given else F.lit(None).cast("double")
    g = cut(cells.groupBy(m).agg(F.sum("n").cast("double").alias("t")).where("t > 0").withColumn("given", given).withColumn("part", F.when(F.col("given").isNull(), F.pow("t", F.lit(t.temper)))))
    named, rest, others, whole = g.agg(F.coalesce(F.sum("given"), F.lit(0.0)), F.sum("part"), F.sum(F.when(F.col("given").isNull(), F.col("t"))), F.sum("t")).first()
    left = max(0.0, 1 - named) if rest else 0.0
    if rest and left < NO_REST:
        left = _own(others, whole, named)
    return g.select(F.col(m).alias("value"), (F.coalesce("given", F.col("part") * (left / rest if rest else 0.0)) / ((named + left) or 1.0)).alias("goal"), (F.col("t") / (whole or 1.0)).alias("has"))


def _raked_by_spark(cells: DataFrame, targets: dict[str, Shares], keep: float, rounds: int = ROUNDS, fit: float = FIT, calibrated: bool = False) -> DataFrame:
    """The same for any number of cells: a table for each round, marginals by aggregates and joins."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0) or 1.0
    shares = cells.withColumn("share", F.col("n") / total)
    goals = {m: cut(_goals(cells, m, targets.get(m, Shares()))) for m in MARGINALS}
    if calibrated:
        for g in goals.values():
            keep = min(keep, g.where("goal > 0").agg(F.min(F.col("has") / F.col("goal"))).first()[0] or keep)
        rounds, fit = BOUNDED_ROUNDS, BOUNDED_FIT * keep
    goal = (lambda: F.col("goal") * keep) if calibrated else (lambda: F.col("goal"))
    mass = F.least(F.lit(1.0), F.col("x")) * F.col("share") if calibrated else F.col("x")
    while True:
        x = shares.withColumn("x", F.lit(keep) if calibrated else F.col("share"))
        for _ in range(rounds):
            worst = 0.0
            for m in MARGINALS:
                now = cut(x.groupBy(m).agg(F.sum(mass).alias("now")).join(goals[m], F.col(m).eqNullSafe(F.col("value"))).select("value", "now", goal().alias("goal")))
                worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
                x = x.join(now, F.col(m).eqNullSafe(F.col("value")), "left").withColumn("x", F.col("x") * F.coalesce(F.col("goal") / F.col("now"), F.lit(0.0))).drop("value", "now", "goal")
            x = cut(x)
            if worst < fit:
                break
        if not calibrated or worst < fit or (x.agg(F.max("x")).first()[0] or 0.0) <= 1:
            break
        keep, fit = keep * LOWER, fit * LOWER
    if calibrated:
        p = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("x"))).otherwise(F.lit(keep))
        return x.select(*MARGINALS, (p / keep).alias("weight"), p.alias("probability"))
    w = x.withColumn("weight", F.when(F.col("n") > 0, F.col("x") * total / F.col("n")).otherwise(1.0))
    low, high = 0.0, 1.0
    expected = lambda c: w.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * c) * F.col("n"))).first()[0] or 0.0
    while expected(high) < keep * total and high < 1e12:
        high *= 2
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < keep * total else (low, mid)
    return w.select(*MARGINALS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def _with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    keyed = cells.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINALS), "weight", "probability")
    same = [F.col(m).eqNullSafe(F.col(f"cell_{m}")) for m in MARGINALS]
    return rows.join(keyed, same[0] & same[1] & same[2]).drop(*(f"cell_{m}" for m in MARGINALS))


def mix(docs: DataFrame, targets: dict[str, Shares] = TARGETS, keep: float = KEEP, calibrated: bool = False) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) of each row."""
    rows = cut(_prepared(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))).drop("text"))
    found = _with_cells(rows, cell_weights(rows, targets, keep, calibrated=calibrated))
    return found.select("doc_id", *MARGINALS, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, targets: dict[str, Shares] = TARGETS, keep: float = KEEP, calibrated: bool = False) -> DataFrame:
    """The rows that the mixture keeps, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    ready = _prepared(rows)
    cells = cell_weights(ready, targets, keep, calibrated=calibrated)
    return _with_cells(ready, cells).where("draw < probability").select("row.*")
