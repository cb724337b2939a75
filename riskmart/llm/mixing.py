"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token counts of the cells
are raked until the shares by source, by language and by topic meet their targets; the
ratio of raked to actual tokens is a cell's weight. Documents are then drawn with
probability proportional to their cell's weight, scaled so that the expected tokens meet
the budget while no probability exceeds one. The draw is a hash of the document id, so
it repeats.

Every source, language and topic is raked as a group of its own. Up to ``max_sources``
sources, ``max_languages`` languages and ``max_cells`` cells the cell totals are raked on
the driver and documents are not shuffled. Beyond that the same steps run on tables of
cells and factors, which stay on the executors, and documents are joined to their cells
as Spark decides. Documents are read twice.

Topics are coarse kinds of text told by their form (``topic``); another function may be
given.

Defined results: NULL sources and languages are groups of their own. Texts without words
carry no tokens and are never drawn. Rows without an id are drawn by their text. Rows
that repeat an id are drawn alike. Other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm.common import pieces, split_words, stored, table

AXES = ("source", "lang", "topic")


@dataclass(frozen=True)
class Settings:
    """``temper`` is the power to which actual shares are raised for the target shares
    of an axis without given targets: 1 keeps them, 0 makes all groups equal. The limits
    tell where the work is done and change no result."""

    temper: tuple[float, float, float] = (0.5, 0.7, 0.9)
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    max_sources: int = 1000
    max_languages: int = 200
    max_cells: int = 100_000
    keep_tokens: float = 0.5
    rounds: int = 200
    tolerance: float = 1e-9
    seed: int = 20240501


def topic(text: str | None) -> str:
    """A coarse kind of text: table, code, record, note, essay or report."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = len(data)
    count = lambda characters: size - len(data.translate(None, characters))
    if count(b"|") * 60 > size:
        return "table"
    if count(b"{}[]();=<>") * 25 > size:
        return "code"
    if count(b"0123456789") * 20 > size:
        return "record"
    return "note" if size < 600 else "essay" if size < 4000 else "report"


def measured(frame: DataFrame, topic_of) -> DataFrame:
    """The frame with ``topic`` and ``tokens`` (words) in place of its last column, ``text``."""
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("topic", T.StringType()),
                           T.StructField("tokens", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([topic_of(t) for t in texts], pa.string()),
                 pa.array([len(split_words(t)) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "topic", "tokens"])

    return frame.mapInArrow(measure, schema)


def rake(tokens: np.ndarray, cells: list[np.ndarray], targets: list[np.ndarray],
         rounds: int, tolerance: float) -> np.ndarray:
    """Weights of the cells so that weighted tokens meet the targets on every axis;
    ``cells`` holds each cell's group number by axis, ``targets`` shares by group."""
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for group, target in zip(cells, targets):
            now = np.bincount(group, weight * tokens, len(target)) / total
            ratio = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, np.abs(target - now)[now > 0].max(initial=0.0))
            weight = weight * ratio[group]
        if worst < tolerance:
            break
    return weight


def probabilities(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities proportional to the weights that spend the budget, at most one."""
    weight = np.where(tokens > 0, weight, 0.0)
    p, full = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    for _ in range(len(tokens) + 1):
        rest = budget - tokens[full].sum()
        open_ = (tokens * weight)[~full].sum()
        p = np.where(full, 1.0, weight * (max(rest, 0.0) / open_ if open_ > 0 else 0.0))
        if not (over := (p > 1) & ~full).any():
            break
        full |= over
    return np.minimum(p, 1.0)


def _joined(cells: DataFrame, factors: dict[str, DataFrame], axes: list[str]) -> DataFrame:
    for axis in axes:
        cells = cells.join(factors[axis], axis)
    return cells


def rake_table(cells: DataFrame, goals: dict[str, DataFrame], total: float, rounds: int,
               tolerance: float) -> DataFrame:
    """``rake`` on tables: the cells with ``weight``, the product of a factor for each of
    their groups. ``goals`` holds each axis's groups and their ``goal``."""
    factors = {a: goals[a].select(a, F.lit(1.0).alias(f"of_{a}")) for a in goals}
    mass = lambda axes: math.prod((F.col(f"of_{a}") for a in axes), start=F.col("tokens"))
    for _ in range(rounds):
        worst = 0.0
        for axis in goals:
            others, factor = [a for a in goals if a != axis], F.col(f"of_{axis}")
            now = (_joined(cells, factors, others).groupBy(axis)
                   .agg((F.sum(mass(others)) / F.lit(total)).alias("now")))
            step = stored(now.join(goals[axis], axis).join(factors[axis], axis).select(
                axis, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(factor).alias(f"of_{axis}"),
                F.when(F.col("now") * factor > 0, F.abs(F.col("goal") - F.col("now") * factor)).alias("gap")),
                "mixing-factors")
            worst = max(worst, step.agg(F.max("gap")).first()[0] or 0.0)
            factors[axis] = step.drop("gap")
        if worst < tolerance:
            break
    weight = math.prod((F.col(f"of_{a}") for a in goals), start=F.lit(1.0))
    return _joined(cells, factors, list(goals)).withColumn("weight", weight).drop(*(f"of_{a}" for a in goals))


def probabilities_table(weighted: DataFrame, budget: float) -> Column:
    """``probabilities`` on a table: cells whose weight is above a bound are full, and the
    bound falls until the budget is spent."""
    bound, n_full = math.inf, -1
    while True:
        full = F.col("weight") > F.lit(bound)
        spent, open_, n = weighted.filter("tokens > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        scale = max(budget - spent, 0.0) / open_ if open_ > 0 else 0.0
        if n == n_full or scale == 0:
            chance = F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
            return F.when(F.col("tokens") > 0, chance).otherwise(0.0)
        bound, n_full = min(bound, 1 / scale), n


def _on_executors(cells: DataFrame, settings: Settings) -> DataFrame:
    """The cells with ``weight`` and ``probability``, raked on tables."""
    cells = cells.withColumn("tokens", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*AXES, F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    goals = {}
    for axis, power in zip(AXES, settings.temper):
        given = settings.targets.get(axis)
        group = cells.groupBy(axis).agg(F.sum("tokens").alias("share"))
        goal = F.when(F.col("share") > 0, F.pow("share", F.lit(power))).otherwise(0.0)
        if given:
            named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "name string, given double")
            group = group.join(named, F.regexp_replace(axis, "^=", "") == F.col("name"), "left")
            goal = F.coalesce("given", F.lit(0.0))
        goal_table = stored(group.select(axis, goal.alias("goal")), "mixing-goals")
        whole = goal_table.agg(F.sum("goal")).first()[0]
        goals[axis] = goal_table.withColumn("goal", F.col("goal") / F.lit(whole)) if whole > 0 else goal_table
    weighted = stored(rake_table(cells, goals, total, settings.rounds, settings.tolerance), "mixing-weights")
    chance = probabilities_table(weighted, settings.keep_tokens * total)
    return weighted.select(*AXES, "weight", chance.alias("probability"))


def _on_driver(cells: DataFrame, settings: Settings) -> DataFrame:
    """The cells with ``weight`` and ``probability``, raked in memory."""
    rows = cells.orderBy(*AXES).collect()
    tokens = np.array([float(r.tokens) for r in rows])
    places, targets = [], []
    for axis, power in zip(AXES, settings.temper):
        names = {n: i for i, n in enumerate(sorted({r[axis] for r in rows}))}
        group = np.array([names[r[axis]] for r in rows], int)
        share = np.bincount(group, tokens, len(names))
        given = settings.targets.get(axis)
        goal = (np.array([given.get(n.removeprefix("="), 0.0) for n in names]) if given
                else np.where(share > 0, share, 0.0) ** power * (share > 0))
        places.append(group)
        targets.append(goal / goal.sum() if goal.sum() > 0 else goal)
    if tokens.sum() > 0:
        weight = rake(tokens, places, targets, settings.rounds, settings.tolerance)
        chance = probabilities(tokens, weight, settings.keep_tokens * tokens.sum())
    else:
        weight = chance = np.zeros(len(tokens))
    return cells.sparkSession.createDataFrame(
        [(*(r[a] for a in AXES), float(w), float(p)) for r, w, p in zip(rows, weight, chance)],
        "source string, lang string, topic string, weight double, probability double")


def _named(column: str) -> Column:
    """The name of a group, as text: NULL has its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("(null)"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", settings: Settings = Settings(),
        topic_of=topic) -> DataFrame:
    """``row`` (all columns of a document), its ``topic``, ``tokens``, ``weight``,
    ``probability`` and whether it is ``selected``."""
    text, groups = F.col(text_col).alias("text"), [F.col(source_col).alias("source"), F.col(lang_col).alias("lang")]
    drawn_by = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit(settings.seed))
    d = measured(documents.select(F.struct("*").alias("row"), drawn_by.alias("hash"), *groups, text), topic_of)
    totals = measured(documents.select(*groups, text), topic_of)
    cells = stored(totals.select(*(_named(a).alias(a) for a in AXES), "tokens")
                   .groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "mixing-cells")
    few = (cells.count() <= settings.max_cells
           and cells.select("source").distinct().count() <= settings.max_sources
           and cells.select("lang").distinct().count() <= settings.max_languages)
    # bounded by the limits on sources, languages and cells, or left to Spark
    cell = F.broadcast(_on_driver(cells, settings)) if few else stored(_on_executors(cells, settings), "mixing-cells")
    cell = cell.select(*(F.col(a).alias(f"c_{a}") for a in AXES), "weight", "probability")
    same = [_named(a) == F.col(f"c_{a}") for a in AXES]
    d = d.join(cell, same)
    draw = F.pmod(F.col("hash"), F.lit(1 << 53)) / float(1 << 53)
    return d.select("row", "topic", "tokens", "weight", "probability",
                    ((draw < F.col("probability")) & (F.col("tokens") > 0)).alias("selected"))


def drawn(documents: DataFrame, **options) -> DataFrame:
    """The selected documents in their own columns, and ``mix_topic``, ``mix_tokens``,
    ``mix_weight`` and ``mix_probability`` (columns of such a name are replaced)."""
    extra = ["topic", "tokens", "weight", "probability"]
    own = [c for c in documents.columns if c not in {f"mix_{e}" for e in extra}]
    return mix(documents, **options).filter("selected").select(
        *(F.col(f"row.`{c}`").alias(c) for c in own), *(F.col(e).alias(f"mix_{e}") for e in extra))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "row.source", "row.lang", "topic", "tokens", "weight", "probability", "selected")
