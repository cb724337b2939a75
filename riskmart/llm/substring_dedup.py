"""Removal of repeated passages by difference-cover anchors.

A passage counts from ``size`` words on. Word positions whose remainder modulo
``PERIOD`` lies in a difference cover start an anchor of ``size - PERIOD + 1`` words.
Wherever two documents share a passage, some shift below ``PERIOD`` brings both to a
cover position, so they share an anchor there: only anchors are shuffled, not all
windows. Shared anchors are then extended to the full windows around them, and these
decide, by their words' 80-bit hash, which document holds a passage first.

Documents are dealt once into blocks of about ``BLOCK_BYTES``, by a hash, and the three
steps (anchors, windows, removal) read that one exchange. A block sends each anchor and
window once, however many of its documents hold it, so a passage in a third of all
documents is a row per block. With its anchors a document sends a fingerprint of all its
words; a copy of an earlier document loses everything and sends no windows.

Defined results: NULL, empty and short texts have no windows and lose nothing. Rows
without an id have no place in the order: they lose nothing and take nothing. Rows that
repeat an id don't take from each other; each is judged alone against smaller ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import (
    covered, hash_spans, hash_windows, mix, pieces, powers, shares, table, text_hashes, word_spans)

PERIOD = 7
BLOCK_BYTES = 2 << 20
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of remainders whose differences give every remainder."""
    for n in range(1, period + 1):
        for cover in combinations(range(period), n):
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be positive")


def anchor_places(n_words: int, size: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """The positions of a text's anchors; none if it is shorter than a window."""
    if n_words < size:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.resize(np.isin(np.arange(period), cover), n_words - (size - period)))


def extended(places: np.ndarray, n_words: int, size: int, period: int) -> np.ndarray:
    """The starts of the windows that hold an anchor at one of ``places``, shifted by
    less than ``period``."""
    n = n_words - size + 1
    begin = np.bincount(np.maximum(places - period + 1, 0), minlength=n + 1)
    end = np.bincount(np.minimum(places + 1, n), minlength=n + 1)
    return np.flatnonzero(np.cumsum(begin - end)[:n] > 0)


def window_keys(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """80 bits for each window: a 64-bit hash and 16 bits of another, not all zero."""
    second = hash_windows(hashes, size, SECOND) >> np.uint64(48)
    return hash_windows(hashes, size), second.astype(np.int64) | 1


def whole_keys(hashes: np.ndarray) -> tuple[int, int]:
    """80 bits for all words of a text, as ``window_keys`` gives for a window."""
    one, two = (mix((hashes * powers(len(hashes), base)[:len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes)))
                for base in (FIRST, SECOND))
    return int(one[0]), int(two[0] >> np.uint64(48)) | 1


def _ends(keys: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each distinct key with its smallest and largest id, in the order of the smallest:
    rows of one document side by side take less room in a shuffle."""
    by_id = np.argsort(ids, kind="stable")
    keys, ids = [k[by_id] for k in keys], ids[by_id]
    mixed = np.zeros(len(ids), np.uint64)
    for k in keys:
        mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(FIRST)
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    begin = np.flatnonzero(new)
    first, last = order[begin], order[np.append(begin[1:], len(ids))[:len(begin)] - 1]
    place = np.argsort(first)
    first, last = first[place], last[place]
    return [k[first] for k in keys], ids[first], ids[last]


def kept_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Some words of a text joined by one space."""
    if not len(starts):
        return b""
    letters = np.frombuffer(data + b" ", np.uint8).copy()
    letters[ends] = 32
    edges = np.zeros(len(letters) + 1, np.int8)
    edges[starts] += 1
    edges[ends + 1] -= 1
    return letters[np.cumsum(edges[:-1]) > 0].tobytes()[:-1]


def _batch(check: np.ndarray, key: np.ndarray, block: np.ndarray, lo: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
    """Rows for a shuffle; the lowest bit of ``holder`` tells whether more than one
    document of the block holds the key."""
    holder = (block * 2 + several).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(check), pa.array(key.view(np.int64)), pa.array(holder), pa.array(lo)],
        ["check", "key", "holder", "lo"])


def _replies(rows: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], dict[tuple[int, int], int]]:
    """Of a block's rows the sorted keys of anchors or windows, each with the id that it
    is kept in (or one below all), and for fingerprints of documents that occur more
    than once the first id."""
    check = rows.column("check").to_numpy()
    key = rows.column("key").to_numpy().view(np.uint64)
    first = rows.column("first").fill_null(np.iinfo(np.int64).min).to_numpy()
    plain = check == 0
    order = np.argsort(key[plain], kind="stable")
    whole = dict(zip(zip(key[~plain].tolist(), check[~plain].tolist()), first[~plain].tolist()))
    return (key[plain][order], first[plain][order]), whole


def _is_copy(doc: int, hashes: np.ndarray, earlier: dict[tuple[int, int], int]) -> bool:
    """Whether a document with a smaller id has the same words."""
    if not earlier:
        return False
    return earlier.get(whole_keys(hashes), doc) < doc


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def mark_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = 13, with_text: bool = True) -> DataFrame:
    """One row per row of ``documents``: how many words it has, how many lie in windows
    that also start in a document with a smaller id, the hash of the kept words and,
    if wanted, the kept words themselves."""
    if size < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    cover, span = difference_cover(PERIOD), size - PERIOD + 1
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = shares(n_bytes, BLOCK_BYTES)
    # anchors only nominate windows: as many hash bits as keep chance hits rare will do
    kept_bits = np.uint64((1 << min(64, n_bytes.bit_length() + 8)) - 1)
    dealt = slim.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition("block")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            found, checks, ids, of = [], [], [], []
            for doc, text, block in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is None:
                    continue
                hashes = text_hashes(text)
                places = anchor_places(len(hashes), size, PERIOD, cover)
                if not len(places):
                    continue
                whole, check = whole_keys(hashes)
                n = len(places) + 1
                found.append(np.append(hash_windows(hashes, span)[places] & kept_bits, np.uint64(whole)))
                checks.append(np.append(np.zeros(n - 1, np.int64), check))
                ids.append(np.full(n, doc, np.int64))
                of.append(np.full(n, block, np.int32))
            (block, check, key), lo, hi = _ends(
                [_joined(of, np.int32), _joined(checks, np.int64), _joined(found, np.uint64)], _joined(ids, np.int64))
            yield _batch(check, key, block, lo, hi > lo)

    def shared(rows: DataFrame) -> DataFrame:
        """The keys that more than one document holds, with the smallest id."""
        same = Window.partitionBy("check", "key")
        several = F.col("holder").bitwiseAND(F.lit(1)) == 1
        return (rows.withColumns({"first": F.min("lo").over(same), "last": F.max("lo").over(same),
                                  "any": F.max(several).over(same)})
                .filter((F.col("first") < F.col("last")) | F.col("any"))
                .select(F.shiftright("holder", 1).alias("block"), "check", "key", "lo", "first",
                        several.alias("several")))

    schema = "check long, key long, holder int, lo long"
    hits = shared(dealt.mapInArrow(anchors, schema)).select(
        "block", "check", "key", F.when(F.col("check") != 0, F.col("first")).alias("first"))

    def windows(docs: pa.Table, hits: pa.Table) -> pa.Table:
        wanted, earlier = _replies(hits)
        wanted = np.unique(wanted[0])
        one, two, ids = [], [], []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            if doc is None or not len(wanted):
                continue
            hashes = text_hashes(text)
            places = anchor_places(len(hashes), size, PERIOD, cover)
            if not len(places) or _is_copy(doc, hashes, earlier):
                continue
            keys = hash_windows(hashes, span)[places] & kept_bits
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            starts = extended(places[wanted[at] == keys], len(hashes), size, PERIOD)
            if len(starts):
                key, check = window_keys(hashes, size)
                one.append(key[starts])
                two.append(check[starts])
                ids.append(np.full(len(starts), doc, np.int64))
        (check, key), lo, hi = _ends([_joined(two, np.int64), _joined(one, np.uint64)], _joined(ids, np.int64))
        # the check in the upper bytes, beside the key, takes less room in a shuffle;
        # fingerprints pass on as they are, with the first id
        whole = np.array([k for k, _ in earlier], np.uint64)
        check = np.append(check << 48, np.array([c for _, c in earlier], np.int64))
        lo = np.append(lo, np.array([*earlier.values()], np.int64))
        several = np.append(hi > lo[:len(hi)], np.ones(len(whole), bool))
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        return pa.Table.from_batches(
            [_batch(check, np.append(key, whole), np.full(len(lo), block, np.int64), lo, several)])

    repeats = (dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(windows, schema))
    # in a block without the first document every holder of the window loses it
    repeats = shared(repeats).filter((F.col("lo") > F.col("first")) | F.col("several")).select(
        "block", F.when(F.col("check").between(1, (1 << 16) - 1), F.col("check")).otherwise(0).alias("check"),
        "key", F.when(F.col("lo") == F.col("first"), F.col("first")).alias("first"))

    def remove(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        (keys, first), earlier = _replies(repeats)
        out = []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            starts, ends = word_spans(data)
            gone = np.zeros(len(starts), bool)
            if doc is not None and len(starts) >= size and (len(keys) or earlier):
                hashes = hash_spans(data, starts, ends)
                if _is_copy(doc, hashes, earlier):
                    gone[:] = True
                elif len(keys):
                    own = hash_windows(hashes, size)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    bad = (keys[at] == own) & (first[at] < doc)
                    gone = covered(np.flatnonzero(bad), size, len(starts))
            kept = kept_words(data, starts[~gone], ends[~gone])
            out.append((doc, len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                        kept.decode("utf-8", "surrogatepass") if with_text else None))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

    return (dealt.groupBy("block").cogroup(repeats.groupBy("block"))
            .applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))


def query(spark, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
        from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)),
f as (select s, min(doc_id) as m from win group by s),
c as (select distinct doc_id, unnest(generate_series(i, i + 12)) as p from win join f using (s) where m < doc_id),
k as (select doc_id, count(c.p) as gone, string_agg(case when c.p is null then x end, ' ' order by k.p) as s
      from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d) k left join c using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed,
       sha256(coalesce(s, '')) as kept_sha256
from d left join k using (doc_id)"""
