"""What the operators share: words, fingerprints, durable results and batches."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space that separates words, and the regular expression that splits on it
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"

#: ``bytes.translate`` table that lower-cases A-Z and nothing else
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first powers of a base modulo 2 ** 64, at least ``n`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(4096, 2 * n), np.uint64(base))
        factors[0] = 1
        known = _POWERS[base] = np.cumprod(factors)
    return known


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT)).otherwise(none)


def once(column: Column) -> Column:
    """The column as an expression that the optimizer leaves where it is. Otherwise it
    may copy a long expression into a filter below or into a lambda, where it would be
    worked out again for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; the same words as ``words`` gives."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.translate(LOWER) if lower else data).split()


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a UTF-8 text start and end."""
    inside = np.concatenate(([False], ~_BLANK[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal on every machine: a polynomial in an
    odd base, whose inverse shifts every span to the same place."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data), _BASE), powers(len(data), _BASE_INVERSE)
    total = np.concatenate((np.zeros(1, np.uint64),
                            np.cumsum(_LETTER[np.frombuffer(data, np.uint8)] * up[:len(data)])))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return hash_spans(data := data.translate(LOWER) if lower else data, *word_spans(data))


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


#: a fixed random number for each byte
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_windows(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; ``base`` is odd."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes), base), powers(len(hashes), pow(base, -1, 1 << 64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)])))
    return mix((total[size:] - total[:n]) * down[:n])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words from one of ``starts``,
    which are all different."""
    edges = np.zeros(n + 1, np.int32)
    edges[starts] += 1
    edges[starts + size] -= 1
    return np.cumsum(edges[:-1]) > 0


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def durable(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Executors may be lost afterwards. Where that setting is absent, a local session
    gets a folder of its own; a cluster without it is an error.
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def shares(n_bytes: int | None, each: int) -> int:
    """Into how many shares of about ``each`` bytes so many bytes go."""
    return max(1, math.ceil((n_bytes or 0) / each))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one makes its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that executors share")
    folder = tempfile.mkdtemp(prefix="riskmart-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the shared folder and read again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
