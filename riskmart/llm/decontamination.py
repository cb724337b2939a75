"""Benchmark decontamination by a broadcast hash set of n-grams.

The windows of the benchmark items go to every task once their size is checked; the
training texts are scanned in one pass without a shuffle. A hash hit counts only
after the words themselves are compared. A benchmark above ``max_broadcast_bytes`` is
scanned in blocks of about that size, one after the other: a pass broadcasts one block and
writes what it hits by fingerprint of the text (128 bits), and the finds of all passes
are then joined to the rows.

Defined results: NULL, empty and wordless texts have no windows and are clean; an item
without an id marks words but is not listed; repeated items and rows are fine, each row
of the documents is judged alone. Other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import covered, hash_windows, mix, pieces, shared_folder, table

#: lower-cases A-Z; everything in ASCII but letters and digits separates words
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256))

DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def _hash(ids: np.ndarray, width: int) -> np.ndarray:
    return hash_windows(mix((ids + 1).astype(np.uint64)), width)


def window_set(items: list[tuple[object, str | None]], size: int = 10) -> tuple[dict, list]:
    """The vocabulary of some benchmark items and, for each window width, the sorted
    hashes of their windows, the windows as word numbers, and the items that hold each."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in item_words(text)]
        width = min(size, len(ids))
        for at in range(len(ids) - width + 1 if ids else 0):
            names = found.setdefault(tuple(ids[at:at + width]), set())
            if item is not None:
                names.add(str(item))
    sets = []
    for width in sorted({len(k) for k in found}):
        keys = [k for k in found if len(k) == width]
        matrix = np.array(keys, np.int64)
        hashes = _hash(matrix.reshape(-1), width)[::width]
        order = np.argsort(hashes, kind="stable")
        sets.append((width, hashes[order], matrix[order], [found[keys[i]] for i in order]))
    return vocabulary, sets


def find(windows: tuple[dict, list], parts: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the items with windows in the text."""
    vocabulary, sets = windows
    hit, names = np.zeros(len(parts), bool), set()
    if not sets or not parts:
        return hit, names
    get = vocabulary.get
    ids = np.fromiter((get(w, -1) for w in parts), np.int64, len(parts))
    unknown = np.concatenate(([0], np.cumsum(ids < 0)))
    for width, hashes, matrix, owners in sets:
        if len(ids) < width:
            continue
        starts = np.flatnonzero(unknown[width:] == unknown[:-width])
        if not len(starts):
            continue
        here = _hash(ids, width)[starts]
        left = np.searchsorted(hashes, here, "left")
        right = np.searchsorted(hashes, here, "right")
        some = right > left
        good = []
        for s, a, b in zip(starts[some], left[some], right[some]):
            for k in range(a, b):
                if np.array_equal(matrix[k], ids[s:s + width]):
                    good.append(s)
                    names |= owners[k]
        if good:
            hit |= covered(np.array(good), width, len(ids))
    return hit, names


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in blocks of at most about ``limit`` bytes, by item."""
    slim = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = 1 if total <= limit else int(2 * total // limit) + 1
    return [slim if n == 1 else slim.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
            for k in range(n)]


@dataclass(frozen=True)
class Benchmark:
    """A benchmark to look for, its columns and limits."""

    items: DataFrame
    item_col: str = "item_id"
    text_col: str = "text"
    size: int = 10
    max_broadcast_bytes: int = 64 << 20

    def blocks(self) -> list[DataFrame]:
        return _blocks(self.items, self.item_col, self.text_col, self.max_broadcast_bytes)

    def shared(self, block: DataFrame):
        """The window set of one block as a broadcast; the driver holds one at a time."""
        windows = window_set([(r[0], r[1]) for r in block.collect()], self.size)
        return block.sparkSession.sparkContext.broadcast(windows)


def _prints() -> list[Column]:
    """A fingerprint of a text, 128 bits: what a text is hit by depends on it alone."""
    return [F.xxhash64("text").alias("f1"), F.xxhash64("text", F.lit(1)).alias("f2")]


FOUND = "f1 long, f2 long, hit binary, items array<string>"


def _hits(texts: DataFrame, benchmark: Benchmark, blocks: list[DataFrame]) -> DataFrame:
    """The hit words (packed bits) and items of every text that has any, by its
    fingerprint: a pass over the texts for each block of the benchmark, whose finds are
    written before the next block is broadcast."""
    rows = texts.select(*_prints(), "text")
    path = None
    for number, block in enumerate(blocks):
        shared = benchmark.shared(block)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                out = []
                for f1, f2, text in zip(*(c.to_pylist() for c in batch.columns)):
                    hit, names = find(shared.value, item_words(text))
                    if hit.any():
                        out.append((f1, f2, np.packbits(hit).tobytes(), sorted(names)))
                f1, f2, hit, names = zip(*out) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(hit, pa.binary()),
                     pa.array(names, pa.list_(pa.string()))], ["f1", "f2", "hit", "items"])

        # one row a text and block, however many copies of the text there are
        found = rows.mapInArrow(look, FOUND).groupBy("f1", "f2").agg(
            F.first("hit").alias("hit"), F.first("items").alias("items"))
        path = path or f"{shared_folder(texts.sparkSession).rstrip('/')}/benchmark-hits-{uuid.uuid4().hex}"
        found.write.mode("append").parquet(path)
        shared.unpersist()
    return texts.sparkSession.read.schema(FOUND).parquet(path).groupBy("f1", "f2").agg(
        F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))


def _united(hits: list[bytes] | None, n: int) -> np.ndarray:
    """The hit words of a text of ``n`` words from what each block found."""
    united = np.zeros(n, bool)
    for hit in hits or ():
        united |= np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool)
    return united


def _digested(ids: pa.Array, rows: list[tuple[int, int, set[str]]]) -> pa.RecordBatch:
    columns = list(zip(*((n_words, n_hit, len(names), hashlib.sha256(
        ",".join(sorted(names)).encode()).hexdigest(), n_hit > 0) for n_words, n_hit, names in rows)))
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(c) for c in columns)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def scan(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         size: int = 10, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: how many of its words lie in benchmark windows, and of
    which items."""
    wanted = Benchmark(benchmark, item_col, item_text_col, size, max_broadcast_bytes)
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, {DIGEST}"
    blocks = wanted.blocks()
    if len(blocks) == 1:
        shared = wanted.shared(blocks[0])

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                rows = []
                for text in batch.column(1).to_pylist():
                    parts = item_words(text)
                    hit, names = find(shared.value, parts)
                    rows.append((len(parts), int(hit.sum()), names))
                yield _digested(batch.column(0), rows)

        return slim.mapInArrow(digest, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _digested(batch.column(0), [
                (n, int(_united(hits, n).sum()), set(items or ()))
                for n, hits, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = pa.array([len(item_words(t)) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n], ["doc_id", "f1", "f2", "n"])

    kind = documents.schema[id_col].dataType.simpleString()
    counted = slim.select("doc_id", *_prints(), "text").mapInArrow(
        count, f"doc_id {kind}, f1 long, f2 long, n long")
    joined = counted.join(_hits(slim, wanted, blocks), ["f1", "f2"], "left")
    return joined.select("doc_id", "n", "hits", "items").mapInArrow(merge, schema)


def remove_documents(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                     max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents without a hit, in their own columns."""
    wanted = Benchmark(benchmark, item_col, item_text_col, size, max_broadcast_bytes)
    blocks = wanted.blocks()
    if len(blocks) > 1:
        rows = _packed(documents, text_col)
        hits = _hits(rows.select("text"), wanted, blocks).select("f1", "f2")
        return rows.join(hits, ["f1", "f2"], "left_anti").select("row.*")
    shared, at = wanted.shared(blocks[0]), documents.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(
                [not find(shared.value, item_words(t))[0].any() for t in batch.column(at).to_pylist()],
                pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)


def _packed(documents: DataFrame, text_col: str) -> DataFrame:
    """The documents as ``row``, with ``text`` and its fingerprint."""
    rows = documents.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return rows.select("row", "text", *_prints())


def _blanked(text: str | None, hit: np.ndarray) -> str | None:
    """The text without its hit words."""
    if not hit.any():
        return text
    data = text.encode("utf-8", "surrogatepass")
    normal, out, end = data.translate(NORMAL), [], 0
    for part, bad in zip(item_words(text), hit):
        start = normal.index(part, end)
        out.append(data[end:start] + (b"" if bad else data[start:start + len(part)]))
        end = start + len(part)
    return (b"".join(out) + data[end:]).decode("utf-8", "surrogatepass")


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                 max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents with every hit word blanked out of the text; separators stay."""
    wanted = Benchmark(benchmark, item_col, item_text_col, size, max_broadcast_bytes)
    blocks = wanted.blocks()
    if len(blocks) > 1:
        rows = _packed(documents, text_col)
        joined = rows.join(_hits(rows.select("text"), wanted, blocks), ["f1", "f2"], "left")
        joined = joined.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns), F.col("hits").alias("__hits"))
        shared = None
    else:
        shared, joined = wanted.shared(blocks[0]), documents
    at, names = documents.columns.index(text_col), documents.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(at).to_pylist()
            if shared is None:
                hits = [_united(h, len(item_words(t))) for h, t in zip(batch.column(len(names)).to_pylist(), texts)]
            else:
                hits = [find(shared.value, item_words(t))[0] for t in texts]
            clean = pa.array(list(map(_blanked, texts, hits)), pa.string())
            columns = [clean if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(strip, documents.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
       from (select item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s
       from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, ks where len(w) >= k)),
h as (select doc_id, dw.k, i, item_id from dw join bw on dw.s = bw.s and dw.k = bw.k),
hw as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + k - 1)) as p from h) group by doc_id),
hi as (select doc_id, count(*) as n, string_agg(x, ',' order by x) as s
       from (select distinct doc_id, cast(item_id as varchar) as x from h where item_id is not null) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hw.n, 0) as bigint) as n_hit,
       cast(coalesce(hi.n, 0) as bigint) as n_items, sha256(coalesce(hi.s, '')) as items_sha256,
       coalesce(hw.n, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)"""
