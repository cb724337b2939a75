"""Hard negatives by shared lists: exact inner-product search for clustered anchors.

Anchors are put into clusters of similar direction. For every cluster the candidates of a
chunk are sorted once by an upper bound that holds for all its members: the candidate's
length times the cosine of its angle to the centre, less the widest angle of a member
(Abuzaid et al., "To index or not to index"). Each member walks that one list and leaves
it when the bound of what follows, times its own length, is below the worst score it still
needs. The search is exact; clusters and starting scores only save work.

The anchors are a stated query set that meets all rows in blocks: a block of at most
``Settings.block_bytes`` is broadcast, every task walks its own candidates, and the few
best of each task are merged by a window. Positives are found in a first pass; a second
pass walks for the negatives, whose score bands follow from them. The result of each
block is written before the next begins.

Fitted on bounded samples chosen by a hash of the id: the centres (``sample_rows``
anchors) and the scores that a walk starts with (``sample_rows`` candidates).

Defined results: rows with a NULL id, label, vector or component, a component that is not
finite, or one of which the whole number lies beyond +-2**27 (scores would not fit a long)
take no part. Vectors of unequal length meet on their common components; an empty vector
has score 0. Of rows that share an id each takes part, and another row is one of another
id. Ties go to the smaller id. Extra columns are ignored; an empty table, or one without
anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import durable, shared_folder, table

LARGEST = 1 << 27
NONE = -(1 << 62)
NEVER = 1 << 62
#: room for rounding in angles and bounds; it can only lengthen a walk
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50
    high_percent: int = 95
    clusters: int = 64
    members: int = 64
    sample_rows: int = 2048
    block_bytes: int = 32 << 20
    chunk_rows: int = 8192
    step: int = 1024


SHORT = "vec_id long, label long, vec binary"
MINED = ("anchor_id long, positive_id long, rank int, negative_id long,"
         " positive_score long, negative_score long")


def prepared(embeddings: DataFrame, settings: Settings, id_col: str = "vec_id",
             label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Rows that take part: ``vec_id``, ``label`` and the vector as packed 32-bit integers."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec")).dropna()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets)
            values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(float)
            ends = (ends - ends[0]).astype(np.int64)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(settings.scale * values)
                bad = ~(np.abs(whole) <= LARGEST)
            before = np.concatenate(([0], np.cumsum(bad)))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer((4 * ends).astype(np.int32)),
                pa.py_buffer(np.where(bad, 0, whole).astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed], ["vec_id", "label", "vec"]).filter(
                pa.array(before[ends[1:]] == before[ends[:-1]]))

    return rows.mapInArrow(pack, SHORT)


def matrix(packed: pa.Array) -> np.ndarray:
    """Packed vectors as rows of doubles, the shorter ones with zeros at the end."""
    vectors = [np.frombuffer(x, "<i4") for x in packed.to_pylist()]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while no partial sum can pass 2**53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if len(a) and len(b) and lengths(a).max() * lengths(b).max() >= 2.0 ** 53:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(lengths(vectors), 1e-12)[:, None]


def centres(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``k`` clusters by spherical k-means, from the first ``k`` vectors."""
    points = directions(vectors)
    found = points[:k]
    for _ in range(rounds):
        near = (points @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found = np.where(lengths(sums)[:, None] > 1e-9, directions(sums), found)
    return found


def nearest(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    width = min(vectors.shape[1], found.shape[1])
    return (vectors[:, :width] @ found[:, :width].T).argmax(1)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each group, by score, then smaller id; in that order."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.searchsorted(sorted_group, sorted_group, "left")
    return order[np.arange(len(order)) - first < k]


class Walk:
    """The anchors of a block, walking the shared lists of their clusters. Slots are what
    an anchor fills: its positives, or the negatives of each positive. ``need`` is the
    least score a slot can still use; scores beyond its ``high`` do not count."""

    def __init__(self, block: dict, k: int, same_label: bool, settings: Settings):
        self.__dict__.update(block)
        self.k, self.same_label, self.settings = k, same_label, settings
        self.n_slots = self.need.shape[1]
        self.norm = lengths(self.vectors)
        self.need = self.need.copy()
        self.held = [np.empty(0, np.int64)] * 3
        self.lists = []
        for c in np.unique(self.cluster):
            members = np.flatnonzero(self.cluster == c)
            centre = directions(self.vectors[members].sum(0)[None])[0]
            cosine = directions(self.vectors[members]) @ centre
            self.lists.append((members, centre, np.arccos(np.clip(cosine, -1, 1)).max(initial=0)))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best of each slot and raise what the full ones need."""
        held = [np.concatenate(x) for x in zip(self.held, (slot, score, ids))]
        keep = best(*held, self.k)
        self.held = [x[keep] for x in held]
        full, last = np.unique(self.held[0][::-1], return_index=True)
        last = len(self.held[0]) - 1 - last
        enough = np.bincount(self.held[0], minlength=self.need.size)[full] >= self.k
        flat = self.need.reshape(-1)
        flat[full[enough]] = np.maximum(flat[full[enough]], self.held[1][last[enough]])

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Every member walks the list of a chunk of candidates."""
        size, step = lengths(vectors), self.settings.step
        for members, centre, widest in self.lists:
            width = min(len(centre), vectors.shape[1])
            cosine = vectors[:, :width] @ centre[:width] / np.maximum(size, 1e-12)
            angle = np.arccos(np.clip(cosine, -1, 1)) - widest - SLACK
            bound = size * np.cos(np.maximum(angle, 0)) * (1 + SLACK) + SLACK
            order = np.argsort(-bound, kind="stable")
            walking = members
            for at in range(0, len(order), step):
                least = self.need[walking].min(1)
                walking = walking[self.norm[walking] * bound[order[at]] + SLACK >= least]
                if not len(walking):
                    break
                seen = order[at:at + step]
                for some in np.array_split(walking, -(-len(walking) // 256)):
                    self.score(some, ids[seen], labels[seen], vectors[seen])

    def score(self, some: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = inner(self.vectors[some], vectors)
        fits = (scores >= self.need[some].min(1)[:, None]) & (scores <= self.high[some].max(1)[:, None])
        if self.same_label:
            fits &= (self.label[some][:, None] == labels) & (self.ids[some][:, None] != ids)
        else:
            fits &= self.label[some][:, None] != labels
        row, column = np.nonzero(fits)
        if not len(row):
            return
        value, anchor = scores[row, column], some[row]
        hit, slot = np.nonzero((value[:, None] >= self.need[anchor]) & (value[:, None] <= self.high[anchor]))
        self.add(anchor[hit] * self.n_slots + slot, value[hit], ids[column[hit]])


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined, then cut, to about ``rows`` rows."""
    waiting, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            waiting.append(batch.slice(at, rows))
            n += waiting[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def walked(rows: DataFrame, block: dict, k: int, same_label: bool, settings: Settings) -> DataFrame:
    """The best of every slot over all rows: ``slot``, ``vec_id``, ``score``, ``rank``."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value, k, same_label, settings)
        for chunk in chunks(batches, settings.chunk_rows):
            walk.meet(*(np.asarray(chunk.column(i)) for i in (0, 1)), matrix(chunk.column(2)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(walk.held[0]), pa.array(walk.held[2]), pa.array(walk.held[1])],
            ["slot", "vec_id", "score"])

    found = rows.mapInArrow(search, "slot long, vec_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def kth(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The k-th best fitting score of each row, or ``NONE`` where fewer fit."""
    if scores.shape[1] < k:
        return np.full(len(scores), NONE)
    return -np.partition(-np.where(fits, scores, NONE), k - 1, axis=1)[:, k - 1]


def _sampled(rows: DataFrame, n: int, most: int) -> list:
    """About ``most`` of ``n`` rows, chosen by a hash of their id, never over twice as many."""
    space = 1 << 31
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(space)) < max(1, space * most // max(n, 1))
    return rows.filter(chosen).limit(2 * most).collect()


def _block(rows: list) -> dict:
    return {"ids": np.array([r.vec_id for r in rows], np.int64),
            "label": np.array([r.label for r in rows], np.int64),
            "vectors": matrix(pa.array([bytes(r.vec) for r in rows], pa.binary()))}


def mine(embeddings: DataFrame, is_anchor: Column, settings: Settings = Settings(),
         id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` (over ``vec_id``) selects, for each of
    their nearest rows of the same label."""
    spark = embeddings.sparkSession
    rows = prepared(embeddings, settings, id_col, label_col, vec_col)
    asked = rows.filter(is_anchor)
    n_rows, n_asked = rows.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], MINED)
    some = _block(_sampled(rows, n_rows, settings.sample_rows))
    middle = centres(_block(_sampled(asked, n_asked, settings.sample_rows) or asked.limit(1).collect())
                     ["vectors"], min(settings.clusters, -(-n_asked // settings.members)))
    fitted = spark.sparkContext.broadcast((some, middle))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, middle = fitted.value
        for batch in chunks(batches, 1024):
            vectors = matrix(batch.column(2))
            ids, labels = (np.asarray(batch.column(i)) for i in (0, 1))
            fits = (labels[:, None] == some["label"]) & (ids[:, None] != some["ids"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest(vectors, middle).astype(np.int32)),
                 pa.array(kth(inner(vectors, some["vectors"]), fits, settings.positives))],
                ["vec_id", "label", "vec", "cluster", "seed"])

    anchors = asked.mapInArrow(place, SHORT + ", cluster int, seed long")
    anchors = durable(anchors.withColumn("no", F.monotonically_increasing_id()))
    starts, parts, n_blocks = _blocks(anchors, settings, len(middle))
    at = F.col("cluster") + 1
    anchors = anchors.withColumn(
        "block", F.element_at(F.lit(starts), at) + F.pmod(F.xxhash64("no"), F.element_at(F.lit(parts), at)))
    path = f"{shared_folder(spark).rstrip('/')}/hard-negatives-{spark.range(1).select(F.expr('uuid()')).head()[0]}"
    for number in range(n_blocks):
        _mined(rows, anchors.filter(F.col("block") == number), fitted, settings).write.mode(
            "append").parquet(path)
    return spark.read.schema(MINED).parquet(path)


def _blocks(anchors: DataFrame, settings: Settings, n_clusters: int) -> tuple[list, list, int]:
    """For each cluster its first block and over how many blocks its anchors are dealt;
    neighbouring clusters share a block while it stays within the bound."""
    sizes = {r["cluster"]: (r["n"], r["bytes"]) for r in anchors.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum(2 * F.length("vec") + 128).alias("bytes")).collect()}
    starts, parts, block, used = [], [], 0, 0
    for c in range(n_clusters):
        size = sizes.get(c, (0, 0))[1]
        share = max(1, -(-size // settings.block_bytes))
        if used and used + size > settings.block_bytes:
            block, used = block + 1, 0
        starts.append(block)
        parts.append(share)
        if share > 1:
            block, used = block + share, 0
        else:
            used += size
    return starts, parts, block + (1 if used else 0)


def _mined(rows: DataFrame, anchors: DataFrame, fitted, settings: Settings) -> DataFrame:
    """The hard negatives of one block of anchors."""
    members = anchors.orderBy("cluster", "no").collect()
    if not members:
        return rows.sparkSession.createDataFrame([], MINED)
    block = _block(members)
    block["cluster"] = np.array([r.cluster for r in members])
    n, k = len(members), settings.positives
    first = block | {"need": np.array([r.seed for r in members], np.int64)[:, None],
                     "high": np.full((n, 1), NEVER)}
    found = walked(rows, first, k, True, settings).collect()  # k rows for each of the block
    score, other = np.full((n, k), NONE), np.zeros((n, k), np.int64)
    for r in found:
        score[r.slot, r["rank"] - 1], other[r.slot, r["rank"] - 1] = r.score, r.vec_id
    low, high = band(score, settings)
    need = np.where((score > NONE) & (low <= high), low, NEVER)
    second = block | {"need": _seeded(rows.sparkSession, block, need, high, fitted, settings),
                      "high": high}
    negatives = walked(rows, second, settings.negatives, False, settings)
    known = rows.sparkSession.sparkContext.broadcast((block["ids"], other, score))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, other, score = known.value
        for b in batches:
            slot = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[slot // k]), pa.array(other.reshape(-1)[slot]), b.column(3),
                 b.column(1), pa.array(score.reshape(-1)[slot]), b.column(2)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return negatives.mapInArrow(name, MINED)


def band(score: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative: ``low_percent`` and ``high_percent`` of the
    positive's, in whole numbers without leaving 64 bits."""
    part = lambda percent: score // 100 * percent + score % 100 * percent // 100
    low, exact = part(settings.low_percent), score % 100 * settings.low_percent % 100 == 0
    return np.where(exact, low, low + 1), part(settings.high_percent)


def _seeded(spark, block: dict, need: np.ndarray, high: np.ndarray, fitted, settings: Settings) -> np.ndarray:
    """What each slot needs to begin with: the last of its best in the sample, if it is more."""
    shared = spark.sparkContext.broadcast((block, need, high))
    n, size = len(need), 1024

    def raised(at: int) -> tuple[int, bytes]:
        block, need, high = shared.value
        some, here = fitted.value[0], slice(at, at + size)
        scores = inner(block["vectors"][here], some["vectors"])
        other = block["label"][here][:, None] != some["label"]
        out = need[here].copy()
        for j in range(out.shape[1]):
            fits = other & (scores >= out[:, j:j + 1]) & (scores <= high[here, j:j + 1])
            out[:, j] = np.maximum(out[:, j], kth(scores, fits, settings.negatives))
        return at, out.tobytes()

    schema = "at long, need binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("at", "need"), raised(at)))],
                    pa.schema([("at", pa.int64()), ("need", pa.binary())]))

    slices = spark.range(0, n, size, numPartitions=-(-n // size))
    done = sorted(slices.mapInArrow(each, schema).collect())
    return np.concatenate([np.frombuffer(r.need, np.int64).reshape(-1, need.shape[1]) for r in done])


#: the same from the definitions; every anchor meets every row
ORACLE = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM taking a JOIN taking b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                               ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
