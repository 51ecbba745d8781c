"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells of (source, language, topic).  Cell weights
are raked, one margin after the other, until the weighted tokens of every
source, language and topic stand in the target proportions: cycles go on until
within each margin all factors agree to ``TOLERANCE``, or ``CYCLES`` are done.  A
document then has ``c * weight`` expected copies, where ``c`` makes the expected
tokens ``keep_share`` of all tokens: that many whole copies, and one more with the
rest as probability.  The draw is a hash of the document's id, so it is repeatable
and needs no shuffle, and the expected tokens meet the targets.

Without ``repeats`` the probability is cut at 1 instead, which takes tokens from the
cells that the targets raise most, so the sample falls short of the targets there.

Targets: a map from value to share for a margin, or else the margin's own token
counts to the power ``temperature``, which flattens them.  Only the proportions
within a margin matter.  DataFrame functions only; the text is read twice and
never shuffled: a cell table within ``BROADCAST_CELLS`` rows is broadcast, a
larger one is joined under ``SALTS`` salts, so that a hot cell is spread.

Cases: a null source or language counts as the empty string; null, blank and empty
texts have no tokens and follow their cell, without extra copies; a very long text is
one document, in or out as a whole; rows that repeat an id are drawn alike; ties are
settled by the hash; a margin value whose cells have no tokens keeps its weight; a
value missing from given targets gets share 0; an empty table gives no rows; all
columns of ``docs`` are kept, and a new column whose name is taken has ``_`` added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from umbra.sources.scratch import forget, written

CYCLES, TOLERANCE, AT_ONCE = 40, 1e-12, 2
TEMPERATURE = 0.7
KEEP_SHARE = 0.8
BROADCAST_CELLS, SALTS = 50_000, 64
MARGINS = ("source", "lang", "topic")


def default_topic(text: Column) -> Column:
    """Topic by tell-tale phrases: ``legal``, ``contact`` or ``general``."""
    low = F.lower(text)
    legal = low.contains("licen") | low.contains("copyright") | low.contains("rights reserved")
    return F.when(legal, "legal").when(low.contains("@") | low.contains("phone"), "contact").otherwise("general")


def _target(margin: str, targets: Mapping[str, Mapping[str, float]], temperature: float) -> Column:
    given = targets.get(margin)
    if given is None:
        return F.pow(F.sum("tokens").over(Window.partitionBy(margin)).cast("double"), F.lit(temperature))
    share = F.lit(0.0)
    for value, part in given.items():
        share = F.when(F.col(margin) == value, F.lit(float(part))).otherwise(share)
    return share


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE, cycles: int = CYCLES, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with a ``weight`` that fits all margins."""
    targets = targets or {}
    now = cells
    for m in MARGINS:
        now = now.withColumn(f"target_{m}", _target(m, targets, temperature))
    now = now.withColumn("weight", F.lit(1.0))
    columns, last = now.columns, None
    for cycle in range(1, cycles + 1):
        for m in MARGINS:
            have = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
            now = now.withColumn(f"have_{m}", have)
            now = now.withColumn(f"factor_{m}", F.when(F.col(f"have_{m}") > 0, F.col(f"target_{m}") / F.col(f"have_{m}")))
            now = now.withColumn("weight", F.col("weight") * F.coalesce(f"factor_{m}", F.lit(1.0)))
        if cycle % AT_ONCE == 0 or cycle == cycles:  # small plans, and the end is seen while they are written
            bounds = {f"{f.__name__}_{m}": f(f"factor_{m}") for m in MARGINS for f in (F.min, F.max)}
            done = written(now, "raked", **bounds)
            if last is not None:
                forget(last)
            last, now = done, done.select(*columns)
            seen = done.observed
            if all(not seen[f"max_{m}"] or seen[f"max_{m}"] <= (seen[f"min_{m}"] or 0) * (1 + tolerance) for m in MARGINS):
                break
    return now.select(*MARGINS, "tokens", "weight")


def _scale(cells: DataFrame, keep_share: float) -> float:
    """The ``c`` at which sum(tokens * min(1, c * weight)) is ``keep_share`` of all tokens."""
    total, weighted = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
    if not total or not weighted:
        return 0.0
    budget = keep_share * total
    c = budget / weighted
    while True:  # cells that reach 1 only grow in number
        full, rest = cells.agg(
            F.sum(F.when(F.col("weight") * c >= 1, F.col("tokens")).otherwise(0)),
            F.sum(F.when(F.col("weight") * c < 1, F.col("tokens") * F.col("weight")).otherwise(0.0)),
        ).first()
        new = (budget - full) / rest if rest and rest > 0 else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def _level(cells: DataFrame, keep_share: float) -> float:
    """The ``c`` at which sum(tokens * c * weight) is ``keep_share`` of all tokens."""
    total, weighted = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
    return keep_share * total / weighted if total and weighted else 0.0


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def mix_copies(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep_share: float = KEEP_SHARE,
    temperature: float = TEMPERATURE,
    seed: str = "mix",
    repeats: bool = True,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` that are sampled: ``row`` (a struct of their columns), ``topic``, ``tokens``,
    ``expected`` copies (without ``repeats`` the probability) and ``copies``."""
    topic = default_topic(F.coalesce(F.col(text_col), F.lit(""))) if topic is None else topic
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        topic.alias("topic"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
    )
    cells = own.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = written(rake(written(cells, "cells"), targets, temperature), "weights", n=F.count(F.lit(1)))
    c = _level(raked, keep_share) if repeats else _scale(raked, keep_share)
    share = F.col("weight") * c
    if not repeats:
        share = F.least(F.lit(1.0), share)
    odds = raked.select(*MARGINS, share.alias("expected"))
    if raked.observed["n"] <= BROADCAST_CELLS:
        joined = own.join(F.broadcast(odds), list(MARGINS))
    else:
        spread = odds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("name", "row"), F.lit(SALTS))).join(spread, [*MARGINS, "salt"])
    draw = F.conv(F.substring(F.md5(F.concat("name", F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    # rows without tokens don't count towards a target, so they are never repeated
    share = F.when(F.col("tokens") > 0, F.col("expected")).otherwise(F.least(F.lit(1.0), "expected"))
    copies = (F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)).cast("int")
    return joined.select("row", "topic", "tokens", "expected", copies.alias("copies")).filter("copies > 0")


def mix_sources(docs: DataFrame, *args, repeats: bool = False, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, then ``mix_topic``, ``mix_tokens`` and ``mix_probability``
    (with ``repeats`` the expected copies of the row, which comes as often as drawn); options as :func:`mix_copies` has."""
    rows = mix_copies(docs, *args, repeats=repeats, **options)
    if repeats:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    named, old = [], docs.columns
    for new, c in (("mix_topic", "topic"), ("mix_tokens", "tokens"), ("mix_probability", "expected")):
        named.append(F.col(c).alias(_free(new, old)))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in old), *named)
