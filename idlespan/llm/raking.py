"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (one per combination of the margins).  The cells' token weights are raked: scaled in turn so that each
margin's sums meet its target shares, and no cell above what it holds at the budget.  A value that has too few tokens for its share gives all, and the
others of its margin share the rest.  Then one factor turns weights into inclusion probabilities that never exceed 1 and whose
expected tokens are the budget, and every document is drawn by a hash of its id.  Only the cells are iterated over.

Every exchange and every broadcast costs the driver a thread and memory, however few its rows.  So goals are written before they are
bounded round by round, and up to ``ONE_TASK`` cells are raked by one task, which needs no exchange; more are dealt out margin by margin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import ascii_lower, saved, whole_text, without_ids

PASSES, PER_PLAN = 20, 5
ROUNDS = 4
ONE_TASK = 1 << 16
SEED = 42
WORD = "[^\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by what the text holds, the first that applies."""
    low = ascii_lower(text)
    return (F.when(low.contains("license") | low.contains("copyright"), "legal")
            .when(low.contains("@") | low.contains("http"), "contact")
            .when(low.contains(" | "), "table")
            .when(F.octet_length(text) >= 8192, "long").otherwise("prose"))


def counted(docs: DataFrame, margins: Sequence[str], tokens: str) -> DataFrame:
    """Cells: the margins, ``tokens`` and ``docs`` in each."""
    return docs.groupBy(*margins).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets that flatten a margin: shares in proportion to tokens to a ``power`` below 1."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def together(df: DataFrame, few: bool) -> DataFrame:
    """``df`` in one task if it has ``few`` rows: no exchange stands before its windows and sums then."""
    return df.coalesce(1) if few else df


def reachable(goal: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``_goal`` (shares that sum to 1) where none exceeds its ``_cap``: what a value cannot take goes to the others, in proportion."""
    for _ in range(rounds):
        fixed = F.col("_goal") >= F.col("_cap")
        held, rest = goal.agg(F.coalesce(F.sum(F.when(fixed, F.col("_cap"))), F.lit(0.0)),
                              F.coalesce(F.sum(F.when(~fixed, F.col("_goal"))), F.lit(0.0))).first()
        if not rest:
            break
        goal = goal.withColumn("_goal", F.when(fixed, F.col("_cap")).otherwise(F.col("_goal") * F.lit((1 - held) / rest)))
    return goal


def rake(cells: DataFrame, targets: dict[str, DataFrame], passes: int = PASSES, keep: float | None = None) -> DataFrame:
    """Cells with ``weight``: the tokens each should have, so that every margin meets its ``share`` (relative to its sum).

    A value of a margin that its targets do not name is given its present share of tokens beside theirs.  Cells without tokens
    stay without.  Targets that contradict each other leave the last margin met.  With ``keep``, the share of tokens that will be drawn, no cell is given
    more than it holds (``tokens`` / ``keep``), and targets are those that can be reached.
    """
    total, n = cells.agg(F.sum("tokens").cast("double"), F.count(F.lit(1))).first()
    total, few = total or 0.0, n <= ONE_TASK
    cells = together(cells, few)
    for margin, shares in targets.items():
        sums = cells.groupBy(margin).agg((F.sum("tokens") / F.lit(total or 1.0)).alias("_own"))
        asked = shares.agg(F.sum("share")).first()[0] or 1.0
        goal = sums.join(shares.select(margin, (F.col("share") / asked).alias("_share")), margin, "left")
        goal = goal.select(margin, F.coalesce("_share", "_own").alias("_goal"), (F.col("_own") / F.lit(keep or 1.0)).alias("_cap"))
        goal = together(saved(goal, "goal"), few)
        if keep:
            whole = goal.agg(F.sum("_goal")).first()[0] or 1.0
            goal = reachable(goal.withColumn("_goal", F.col("_goal") / whole))
        cells = together(saved(cells.join(goal.select(margin, F.col("_goal").alias(f"_goal_{margin}")), margin), "cells"), few)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for done in range(0, passes, PER_PLAN):
        for _ in range(min(PER_PLAN, passes - done)):
            for margin in targets:
                own = Window.partitionBy(margin)
                if keep:
                    now = now.withColumn("weight", _bounded(F.col(f"_goal_{margin}") * F.lit(total), F.col("tokens") / F.lit(keep), own))
                    continue
                # shares of one margin may not sum to 1 over the values present; scaling by the weight of all cells mends that
                now = now.withColumn("weight", F.col("weight") * F.coalesce(
                    F.col(f"_goal_{margin}") * F.lit(total) / F.nullif(F.sum("weight").over(own), F.lit(0.0)), F.lit(0.0)))
        now = together(saved(now, "cells"), few)
    return now.drop(*[f"_goal_{m}" for m in targets])


def _bounded(goal: Column, most: Column, own: Window) -> Column:
    """Weights of one margin scaled to its goal; on the way up, cells that hold all they can stay and the others take their part."""
    weight = F.col("weight")
    full = weight >= most * (1 - 1e-9)
    held = F.coalesce(F.sum(F.when(full, weight)).over(own), F.lit(0.0))
    free = F.sum(F.when(~full, weight)).over(own)
    down = goal / F.nullif(F.sum(weight).over(own), F.lit(0.0))
    up = F.least(most, weight * (goal - held) / F.nullif(free, F.lit(0.0)))
    return F.when(down <= 1, weight * down).when(full, most).otherwise(F.coalesce(up, F.lit(0.0)))


def reached_shares(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``margin``, ``value``, ``target`` and ``reached`` shares of the tokens to expect, of cells with ``probability``."""
    out = None
    for margin, shares in targets.items():
        expected = cells.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("probability")).alias("_kept"))
        whole = expected.agg(F.sum("_kept")).first()[0] or 1.0
        asked = shares.agg(F.sum("share")).first()[0] or 1.0
        rows = expected.join(shares, margin, "left").select(
            F.lit(margin).alias("margin"), F.col(margin).alias("value"), (F.col("share") / asked).alias("target"), (F.col("_kept") / whole).alias("reached"))
        out = rows if out is None else out.unionByName(rows)
    return out


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """Cells with ``probability``: min(1, factor x weight / tokens), the factor such that ``keep`` of the tokens are expected.

    Cells that reach 1 are taken whole and the factor is found again for the rest, until no further cell reaches it.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.col("weight") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0))
    factor = 0.0
    whole = F.lit(False)
    while True:
        full, rest = cells.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)),
                               F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0))).first()
        found = (keep * total - full) / rest if rest > 0 else 0.0
        if found <= factor:
            break
        factor, whole = found, F.coalesce(F.lit(found) * ratio >= 1, F.lit(False))
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.lit(factor) * ratio), F.lit(1.0)))


def drawn(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the key; null counts as the empty string."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEEP = 0.8


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``source``, ``lang``, ``topic`` and ``tokens`` of every row; a null source or language is the empty string."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
                       topic_of(text).alias("topic"), token_count(text).alias("tokens"))


def mixed(docs: DataFrame, keep: float = KEEP, powers: dict[str, float] | None = None,
          targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
          passes: int = PASSES) -> DataFrame:
    """One row per input row: id, ``source``, ``lang``, ``topic``, ``tokens``, ``weight`` (raked tokens per token), ``probability``, ``selected``.

    ``targets`` holds a table (margin, ``share``) per margin; by default shares are tempered by ``powers``.  ``keep`` is the share of tokens
    to expect.  Texts without words weigh nothing and stay.  Rows that repeat an id are drawn together; null ids share one
    draw per cell; other columns are ignored; an empty table gives none.
    """
    rows = saved(described(docs, id_col, text_col), "described")
    margins = list(powers or targets or MARGINS)
    cells = saved(counted(rows, margins, "tokens"), "cells")
    cells = together(cells, cells.count() <= ONE_TASK)
    targets = targets or {m: tempered(cells, m, p) for m, p in (powers or MARGINS).items()}
    cells = probabilities(rake(cells, targets, passes, keep), keep)
    per_token = F.coalesce(F.col("weight") / F.nullif(F.col("cell_tokens").cast("double"), F.lit(0.0)), F.lit(0.0))
    found = rows.join(cells.withColumnRenamed("tokens", "cell_tokens").drop("docs"), margins)
    return found.select(F.col("id").alias(id_col), "source", "lang", "topic", "tokens", per_token.alias("weight"), "probability",
                        ((F.col("tokens") == 0) | (drawn(F.col("id"), seed) < F.col("probability"))).alias("selected"))


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The selected rows of ``docs``, columns as they came.  Rows with one id stay or go together, null ids among themselves too."""
    return without_ids(docs, id_col, mixed(docs, id_col=id_col, **options).filter("not selected").select(id_col), nulls=True)
