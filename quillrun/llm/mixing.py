"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The most that the exponent of any document may be: exp of it is finite, and so are sums of many.
MOST = 600.0
#: Margins further off their targets than this part are reported.
REPORTED = 1e-6
#: Significant digits of a multiplier.
DIGITS = 9
#: The two margins that the targets hold: tokens by source and tokens by language.
MARGINS = ("source", "lang")


def word_count(text: Column) -> Column:
    """Tokens of a document for the balance: its words (runs without ASCII white space)."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("bigint")


@dataclass(frozen=True)
class Balance:
    """Per-cell multipliers: a document of t tokens in a cell has rate exp(lam * t / scale)."""

    cells: list[tuple]
    lam: np.ndarray
    scale: float
    iterations: int
    gap: float


def tempered(totals: dict, alpha: float) -> dict:
    """Target shares proportional to each part's tokens to the power alpha."""
    raw = {k: v**alpha for k, v in totals.items() if v > 0}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()}


def balance(
    sized: DataFrame,
    targets: dict[str, dict] | None = None,
    *,
    alpha: float = 0.7,
    budget: float = 1.0,
    tolerance: float = 1e-9,
    max_iterations: int = 60,
) -> Balance:
    """Solve for the multipliers over ``sized`` (source, lang, __t, and perhaps __d,
    how many documents a row stands for).

    Of all rates w_d with the wanted token sums, sum w_d t_d = target for each
    source and language, that with the least relative entropy to equal rates is
    w_d = exp((a_source + b_lang) t_d / scale); a and b minimise the convex dual
    sum_d exp(x_d . theta) - target . theta. Newton's steps need, for each
    (source, language) cell, sum w, sum w t and sum w t^2 at the current
    multipliers: one aggregation over all documents an iteration, of which only a
    row a cell reaches the driver. A step that doesn't lower the dual is halved.
    No document's exponent may pass MOST, which is held by each cell's own longest
    document; how far below zero one is doesn't matter. Targets that aren't met to
    a part of REPORTED are warned of, and ``gap`` says how far off they are.
    The dual is flat where margins depend on each other (both sum to the budget),
    which the least-squares solution of a step settles. Where a step is expected to
    lower the dual by less than rounding it is taken whole, and is the last.

    ``targets`` has shares by margin, summing to 1; a value without documents is
    left out and the rest scaled up (ValueError if nothing is left); by default
    both margins are ``tempered``. Multipliers are rounded to DIGITS significant
    digits, well below the tolerance, so that the order in which tasks add their
    sums doesn't show in rates or copies.
    ``budget`` is the tokens wanted as a part of those there are."""
    docs = F.col("__d") if "__d" in sized.columns else F.lit(1)
    totals = sized.where("__t > 0").groupBy(*MARGINS).agg(F.sum(docs * F.col("__t")).alias("t"), F.max("__t").alias("m")).collect()
    totals.sort(key=lambda r: tuple((r[m] is not None, r[m] or "") for m in MARGINS))
    cells = [tuple(r[m] for m in MARGINS) for r in totals]
    if not cells:
        return Balance([], np.zeros(0), 1.0, 0, 0.0)
    whole = float(sum(r["t"] for r in totals))
    rows, goal = [], []
    for k, margin in enumerate(MARGINS):
        there: dict = {}
        for cell, r in zip(cells, totals):
            there[cell[k]] = there.get(cell[k], 0) + r["t"]
        share = (targets or {}).get(margin) or tempered(there, alpha)
        known = sum(v for x, v in share.items() if x in there)
        if not known > 0:
            raise ValueError(f"no target of {margin} has documents")
        for value in there:
            rows.append([float(c[k] == value) for c in cells])
            goal.append(budget * share.get(value, 0.0) / known)
    a, goal = np.array(rows), np.maximum(np.array(goal), 1e-12)  # margins x cells; in parts of the whole
    scale = max(float(max(r["m"] for r in totals)), 1.0)

    def sums(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By cell: sum of w, of w t, of w t^2, all tokens in parts of the scale."""
        got = np.zeros((3, len(cells)))
        where = {c: i for i, c in enumerate(cells)}
        w = F.exp(cell_value(cells, lam) * F.col("__t") / scale) * docs
        x = F.col("__t") / scale
        agg = sized.where("__t > 0").groupBy(*MARGINS).agg(F.sum(w), F.sum(w * x), F.sum(w * x * x))
        for r in agg.collect():
            got[:, where[r[0], r[1]]] = r[2], r[3], r[4]
        return got[0], got[1], got[2]

    longest = np.array([float(r["m"]) for r in totals]) / scale
    unit = whole / scale
    theta = np.zeros(len(a))
    w0, w1, w2 = sums(a.T @ theta)
    value, gap, done = w0.sum() / unit - goal @ theta, np.inf, 0
    for done in range(1, max_iterations + 1):
        gradient = a @ w1 / unit - goal
        gap = float(np.abs(gradient / goal).max())
        if gap < tolerance:
            break
        step = np.linalg.lstsq((a * (w2 / unit)) @ a.T, -gradient, rcond=1e-12)[0]
        if -(gradient @ step) < 1e-13 * abs(value) and (a.T @ (theta + step) * longest).max() < MOST:
            # A whole step lowers the dual by less than its sum is exact to: the last.
            theta, done = theta + step, done + 1
            w1 = sums(a.T @ theta)[1]
            break
        size = 1.0
        while True:
            tried = theta + size * step
            if (a.T @ tried * longest).max() < MOST:
                n0, n1, n2 = sums(a.T @ tried)
                new = n0.sum() / unit - goal @ tried
                if new <= value + 1e-4 * size * (gradient @ step) or size < 1e-6:
                    break
            elif size < 1e-6:
                tried = None
                break
            size /= 2
        if tried is None:
            break
        stalled = value - new <= 1e-15 * abs(value) and size < 1e-6
        theta, value, w1, w2 = tried, new, n1, n2
        if stalled:
            break
    gap = float(np.abs((a @ w1 / unit - goal) / goal).max())
    if not gap <= REPORTED:
        warnings.warn(f"mixing: after {done} iterations a margin is off its target by a part of {gap:.3g}", RuntimeWarning, stacklevel=2)
    lam = np.array([float(f"{x:.{DIGITS}g}") for x in a.T @ theta])
    return Balance(cells, lam, scale, done, gap)


def cell_value(cells: list[tuple], values, margins: tuple[str, ...] = MARGINS) -> Column:
    """A cell's value as a lookup in a literal map; there is a row a (source, language)."""
    if not cells:
        return F.lit(0.0)
    key = lambda c: "\x01".join("\x00" if x is None else str(x) for x in c)
    pairs = [F.lit(x) for c, v in zip(cells, values) for x in (key(c), float(v))]
    at = F.concat_ws("\x01", *(F.coalesce(F.col(m).cast("string"), F.lit("\x00")) for m in margins))
    return F.coalesce(F.element_at(F.create_map(*pairs), at), F.lit(0.0))


def unit_hash(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    h = F.xxhash64(*columns, F.lit("mixing"))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def mixing_rates(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    *,
    alpha: float = 0.7,
    budget: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, rate, copies``.

    Copies are the rate rounded down, and one more with probability its fraction,
    by a hash of the id: on average exactly the rate, without a pass over the data,
    and the same on every run. Texts are read once, to be counted; the Newton
    iterations read the number of documents of each (source, lang, tokens) from a
    table in the shared folder.

    Documents of null or empty text weigh nothing in any sum: rate 1, one copy.
    Null sources and languages are parts of their own. Repeated rows count each
    time and get equal rates, and rows of one id round alike; an empty table gives
    none; other columns, whatever their names, are ignored.
    """
    sized, found = _solve(docs, targets, alpha, budget, id_col, text_col)
    rated = sized.select("doc_id", F.col("__t").alias("n_tokens"), _rate(found).alias("rate"))
    return rated.withColumn("copies", _copies(F.col("rate"), "doc_id"))


def _solve(docs, targets, alpha, budget, id_col="doc_id", text_col="text") -> tuple[DataFrame, Balance]:
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col("source"), F.col("lang"), _tokens(text_col).alias("__t")), "mixing"
    )
    alike = materialize(sized.groupBy(*MARGINS, "__t").agg(F.count(F.lit(1)).alias("__d")), "alike")
    return sized, balance(alike, targets, alpha=alpha, budget=budget)


def _tokens(text_col: str) -> Column:
    return F.coalesce(word_count(F.col(text_col)), F.lit(0))


def _rate(found: Balance, tokens: str = "__t", margins: tuple[str, ...] = MARGINS) -> Column:
    return F.exp(cell_value(found.cells, found.lam, margins) * F.col(tokens) / found.scale)


def _copies(rate: Column, id_col: str) -> Column:
    whole = F.floor(rate)
    return (whole + (unit_hash(id_col) < rate - whole).cast("bigint")).cast("bigint")


def mixed_documents(docs: DataFrame, targets: dict[str, dict] | None = None, *, alpha: float = 0.7, budget: float = 1.0) -> DataFrame:
    """Each row of ``docs``, all columns whatever their names, as often as
    ``mixing_rates`` gives it copies. Copies are made where the row is read, without
    a join or a shuffle. Rows of null or empty text have one copy; rows that repeat
    are each copied, all alike; null ids too; an empty table gives none."""
    _, found = _solve(docs.select("doc_id", "text", *MARGINS), targets, alpha, budget)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    given = docs.toDF(*names).withColumn("t", _tokens(at["text"]))
    given = given.withColumn("rate", _rate(found, "t", tuple(at[m] for m in MARGINS))).withColumn("n", _copies(F.col("rate"), at["doc_id"]))
    # An outer explode and a filter after it: one before it would count every text again.
    copied = given.select(*names, F.explode_outer(F.array_repeat(F.lit(True), F.col("n").cast("int"))).alias("i"))
    return copied.where("i").select(*names).toDF(*docs.columns)
