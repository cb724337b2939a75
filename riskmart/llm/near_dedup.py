"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents with the same set of word shingles are one class at once. For the others,
bands of MinHash values name buckets. Candidates are first each bucket's members with
one centre, then those in another component than one of ``Settings.centres`` further
centres with these. What these links have not joined meets in an exact prefix join over
the rarest shingles, across components only. So a bucket of thousands of near copies
costs pairs in proportion to its members, not their square, and no link is lost. Pairs
with centres are only made of documents that can be similar enough, given how many
shingles each has that no other document in these buckets has.

A candidate's signatures are compared batch by batch. After each batch the posterior of
the similarity, given the matches so far, tells how likely a link still is; below
``miss`` the pair is dropped. The survivors are verified on the full shingle sets.

Defined results: NULL, empty and blank texts have no shingles and no links. A text with
fewer words than a shingle has its whole word sequence as one. Rows without an id get a
result without links and a count of zero. Rows that repeat an id are one document that
has the links of each of them; every such row gets the same result, with the largest
count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import durable, hash_windows, mix, pieces, split_words, table, text_hashes
from riskmart.llm.components import components


@dataclass(frozen=True)
class Settings:
    """A link at the threshold t stays unseen by the bands with probability
    (1 - t ** rows) ** bands, 5e-8 by default."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    centres: int = 8


def shingles(text: str | None, size: int) -> set[bytes]:
    """The distinct word shingles of a text, as bytes."""
    parts = split_words(text, lower=True)
    if len(parts) < size:
        return {b" ".join(parts)} if parts else set()
    runs = [parts[k:len(parts) - size + 1 + k] for k in range(size)]
    return set(map(b" ".join, zip(*runs)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    hashes = text_hashes(text, lower=True)
    if not len(hashes):
        return hashes
    return np.unique(hash_windows(hashes, min(size, len(hashes))) + np.uint64(min(size, len(hashes))))


def signature(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the smallest of the keys under its permutation, 32 bits each."""
    least = np.full(len(seeds), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(keys), 512):
        part = (keys[at:at + 512][None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, part.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def permutation_seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """For each number of compared values, the fewest matches with which a link stays
    likelier than ``miss``: the posterior of the similarity under a uniform prior is a
    beta distribution, its tail above the threshold a binomial sum."""
    t, total, out = settings.percent / 100, settings.bands * settings.rows, []
    for n in range(settings.batch, total + 1, settings.batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= settings.miss:
                break
        out.append((n, m))
    return out


def signatures(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``content`` (a fingerprint of the shingle set),
    ``sig`` and ``buckets`` (a hash for each band) of every row with shingles."""
    seeds, bands, rows = permutation_seeds(settings.bands * settings.rows), settings.bands, settings.rows
    size = settings.shingle

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.uint64)
        for batch in pieces(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = shingle_hashes(text, size)
                if not len(keys):
                    continue
                sig = signature(keys, seeds)
                key = mix(number + np.uint64(1))
                for row in sig.reshape(bands, rows).T:
                    key = mix(key ^ row)
                out.append((doc, len(keys), hashlib.md5(keys.tobytes()).digest(), sig.tobytes(),
                            key.view(np.int64)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["doc_id", "n_shingles", "content", "sig", "buckets"])

    return documents.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, content binary, sig binary, buckets array<long>")


def likely(pairs: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (``a``, ``b``) that the sequential test does not drop."""
    total, table_ = settings.bands * settings.rows, least_matches(settings)
    sigs = signed.select("doc_id", "sig")
    both = (pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
            .select("a", "b", "sig_a", "sig_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, total)
                    for i in (2, 3))
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), int), 0
            for n, least in table_:
                matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
                stay = matches >= least
                alive, matches, done = alive[stay], matches[stay], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return both.mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    size, percent = settings.shingle, settings.percent
    both = (pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in pieces(batches, 256):
            keep = []
            for a, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, known = a, shingles(ta, size)
                other = shingles(tb, size)
                shared = len(known & other)
                keep.append(100 * shared >= percent * (len(known) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


def centres(members: DataFrame, number: int, *also: str) -> DataFrame:
    """For each bucket its members that come first in a random order, one for each of
    ``number`` classes of ids, as ``centre`` with the columns ``also``. Partial
    aggregates find them, however full a bucket is."""
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = F.min_by(F.struct(F.col("doc_id").alias("centre"), *also), order) if also else F.min_by("doc_id", order)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(number))
    found = members.groupBy("bucket", part.alias("part")).agg(chosen.alias("chosen"))
    if not also:
        return found.select("bucket", F.col("chosen").alias("centre"))
    return found.select("bucket", "chosen.centre", *(F.col(f"chosen.{c}").alias(f"centre_{c}") for c in also))


def pairs_of(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def unjoined(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``bucket``, ``doc_id`` and ``component`` of the members of buckets that still hold
    more than one component."""
    labelled = members.join(joined, members.doc_id == joined.node, "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = (labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter(F.col("lo") < F.col("hi")).select("bucket"))
    return durable(labelled.join(mixed, "bucket"))


def own_shingles(texts: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and ``n_own``: how many shingles of a document no other one of ``texts``
    has."""
    size = settings.shingle

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            keys = [shingle_hashes(t, size) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(k) for k in keys])),
                 pa.array(np.concatenate(keys).view(np.int64))], ["doc_id", "key"])

    alone = (texts.mapInArrow(emit, "doc_id long, key long").groupBy("key")
             .agg(F.count("*").alias("n"), F.min("doc_id").alias("node")).filter("n = 1"))
    return alone.groupBy("node").agg(F.count("*").alias("n_own"))


def within_reach(percent: int, x: str, y: str) -> Column:
    """Whether two documents can be similar enough: what they share is at most the
    shingles that neither has for itself. Unknown counts exclude nothing."""
    most = F.least(F.col(f"{x}_n") - F.col(f"{x}_own"), F.col(f"{y}_n") - F.col(f"{y}_own"))
    return F.coalesce(most * (100 + percent) >= (F.col(f"{x}_n") + F.col(f"{y}_n")) * percent, F.lit(True))


def rare_first(texts: DataFrame, settings: Settings) -> DataFrame:
    """The rarest shingles of each document, as many as a prefix join needs: ``key``,
    ``doc_id``, ``component``, the place ``i`` and the number ``n`` of all its shingles.
    Rarity is the logarithm of how often a hash bucket occurs in these texts; the
    buckets are a fixed number."""
    size, percent, n_buckets = settings.shingle, settings.percent, 1 << 16
    low = np.uint64(n_buckets - 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in pieces(batches, 256):
            for text in batch.column(1).to_pylist():
                total += np.bincount((shingle_hashes(text, size) & low).astype(int), minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = texts.mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    classes = np.zeros(n_buckets, np.uint64)
    for bucket, n in counts:
        classes[bucket] = int(4 * math.log2(1 + n))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out = [[np.empty(0, np.int64)] for _ in range(5)]
            for doc, text, component in zip(*(c.to_pylist() for c in batch.columns)):
                keys = shingle_hashes(text, size)
                n = len(keys)
                first = np.lexsort((keys, classes[(keys & low).astype(int)]))[:n - (n * percent + 99) // 100 + 1]
                for column, values in zip(out, (keys[first].view(np.int64), np.full(len(first), doc),
                                                np.full(len(first), component), np.arange(len(first)),
                                                np.full(len(first), n))):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                             ["key", "doc_id", "component", "i", "n"])

    return texts.mapInArrow(emit, "key long, doc_id long, component long, i long, n long")


def links(signed: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and ``component`` for every document that is linked with a different
    shingle set; ``signed`` holds one row for each set."""
    members = signed.select("doc_id", F.explode("buckets").alias("bucket"))
    several = (members.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
               .filter(F.col("lo") < F.col("hi")).select("bucket"))
    shared = durable(members.join(several, "bucket"))
    stars = shared.join(centres(shared, 1), "bucket").filter(F.col("doc_id") != F.col("centre"))
    found = durable(verified(likely(pairs_of(stars, "doc_id", "centre"), signed, settings), texts, settings))
    joined = components(found)

    apart = unjoined(shared, joined)
    texts = durable(texts.join(apart.select("doc_id").distinct(), "doc_id", "left_semi"))
    counts = signed.groupBy("doc_id").agg(F.count("*").alias("sets"), F.max("n_shingles").alias("n"))
    counts = (counts.filter("sets = 1").join(own_shingles(texts, settings), F.col("doc_id") == F.col("node"), "left")
              .select(F.col("doc_id").alias("of"), "n", F.coalesce("n_own", F.lit(0)).alias("own")))
    apart = apart.join(counts, apart.doc_id == counts.of, "left").drop("of")
    # a document with too many shingles of its own is similar to none of the others
    apart = durable(apart.filter(F.coalesce((F.col("n") - F.col("own")) * 100 >= F.col("n") * settings.percent, F.lit(True))))
    known = ("component", "n", "own")
    some = centres(apart, settings.centres, *known)
    stars = (apart.toDF("bucket", "doc_id", *(f"x_{c}" for c in known))
             .join(some.toDF("bucket", "centre", *(f"y_{c}" for c in known)), "bucket")
             .filter((F.col("x_component") != F.col("y_component")) & within_reach(settings.percent, "x", "y")))
    more = durable(verified(likely(pairs_of(stars, "doc_id", "centre"), signed, settings), texts, settings))
    if not more.isEmpty():
        found = found.union(more)
        joined = components(found)
        left = unjoined(apart.select("bucket", "doc_id"), joined)
        apart = left.join(apart.drop("component"), ["bucket", "doc_id"]).select("bucket", "doc_id", *known)

    # exact for the rest: documents in different components, whatever their buckets
    rest = texts.join(apart.select("doc_id", "component").distinct(), "doc_id")
    rows = durable(rare_first(rest.select("doc_id", "text", "component"), settings))
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "component", "i", "n"))) for s in "xy")
    ahead = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    cross = x.join(y, "key").filter(
        (F.col("component_x") != F.col("component_y")) & (F.col("doc_id_x") < F.col("doc_id_y"))
        & (ahead * (100 + settings.percent) >= (F.col("n_x") + F.col("n_y")) * settings.percent))
    more = durable(verified(pairs_of(cross, "doc_id_x", "doc_id_y"), texts, settings))
    return joined if more.isEmpty() else components(found.union(more))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id``
    (the smallest id reachable over links) and ``kept`` (whether it is its own)."""
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = durable(signatures(slim.filter(F.col("doc_id").isNotNull()), settings))
    owners = signed.groupBy("content").agg(F.min("doc_id").alias("owner"))
    alone = (signed.join(owners, (signed.doc_id == owners.owner) & (signed.content == owners.content))
             .drop(owners.content).dropDuplicates(["doc_id", "content"]))
    alone = durable(alone.select("doc_id", "n_shingles", "sig", "buckets"))
    texts = slim.filter(F.col("doc_id").isNotNull())
    reach = links(alone, texts, settings)
    of_set = (owners.join(reach, owners.owner == reach.node, "left")
              .select("content", F.coalesce("component", "owner").alias("component_id")))
    found = (signed.select("doc_id", "n_shingles", "content").join(of_set, "content")
             .groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"),
                                    F.min("component_id").alias("component_id")))
    return (slim.select("doc_id").join(found, "doc_id", "left")
            .select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                settings: Settings = Settings()) -> DataFrame:
    """The documents without those that a smaller id stands for, in their own columns."""
    gone = classes(documents, id_col, text_col, settings).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__gone"))
    return documents.join(gone, documents[id_col].cast("long") == gone["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), settings=Settings(shingle=2))


ORACLE = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 1], ' ') as s
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as root from d union select e.b, r.root from r join e on e.a = r.node),
m as (select node, min(root) as root from r group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, root as component_id, d.doc_id = root as kept
from d left join n using (doc_id) join m on node = d.doc_id"""
