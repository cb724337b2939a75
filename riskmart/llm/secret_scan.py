"""Secrets in texts: base patterns, and a linear-chain conditional random field over tokens.

Three patterns (``BASE``) find secrets of known form. The field finds the rest: runs of
letters and digits and single marks are tokens with the tags outside, begin and inside;
their features are shape (length, kinds of characters, changes between letters and digits,
vowels), the words and shapes beside them and how the whole text looks. Viterbi decodes
the best tags of a text; a span that meets no base span is added as kind ``field``.

A token that no best path can tag as part of a secret, whatever its neighbours are, is known
by a bound on its score alone, so Viterbi only runs between such tokens. Nothing is shuffled;
each text is scanned whole, its token features in slabs.

The field is learned from windows of a bounded sample: at most ``max_windows`` with base
spans and as many without, from about ``sample_docs`` documents chosen by a hash of the id.
Base spans are the positive labels. Windows with other tokens that look random say nothing
and are left out; each positive window is also learned without its neighbouring words, and
without its exact shapes, so that a coarse shape alone can tell a secret.

Defined results: NULL and empty texts have no spans. Without a base span in the sample there
are base spans only. Rows are judged one by one, so repeated ids or rows are fine. Extra
columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import LOWER, hash_spans, pieces, table

# Kinds in the order of reports, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6

OUT, BEGIN, INSIDE = 0, 1, 2
BARRED = -1e6
BUCKETS = 4096


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 10_000
    max_windows: int = 1500
    around: int = 12
    rounds: int = 60
    rate: float = 0.15
    ridge: float = 1e-3
    min_chars: int = 8
    slab: int = 200_000


# ---------------------------------------------------------------- base spans

def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the base matches, in order. Longest
    runs make the least lengths of ``access`` and ``hex`` part of their patterns."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


# ---------------------------------------------------------------- tokens and features

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_SMALL = (_BYTE >= 97) & (_BYTE <= 122)
_HIGH = _BYTE > 127
_RUN = _DIGIT | _UPPER | _SMALL | _HIGH | (_BYTE == 95)
_BLANK = np.isin(_BYTE, list(b" \t\n\x0b\x0c\r"))
_VOWEL = np.isin(_BYTE, list(b"aeiouyAEIOUY"))
_NIBBLE = _DIGIT | ((_BYTE >= 97) & (_BYTE <= 102))
_KIND = _DIGIT * 1 + _UPPER * 2 + _SMALL * 3

_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
N_LENGTH = len(_LENGTHS) + 1
#: sizes of the blocks of features, one feature of each block per token
BLOCKS = (4, 33, 65, N_LENGTH * 32 + 1, 7 * N_LENGTH + 1, 10 * N_LENGTH + 1, 257, 8, 200, BUCKETS,
          BUCKETS, BUCKETS, BUCKETS, BUCKETS, N_LENGTH * 32 + 1, N_LENGTH * 32 + 1)
STARTS = np.concatenate(([0], np.cumsum(BLOCKS)))
#: blocks that copies of a positive window do without: words beside it; exact shapes and the look of the file
WORDS_BESIDE = (10, 11, 12, 13)
EXACT = (1, 2, 3, 4, 5, 8, 9, 14, 15)


class Tokens:
    """The tokens of some texts laid end to end. Spans are bytes of ``data``."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.text_starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        b = np.frombuffer(self.data, np.uint8)
        run = _RUN[b]
        token = ~_BLANK[b]
        first = token & ~(run & np.concatenate(([False], run[:-1])))
        last = token & ~(run & np.concatenate((run[1:], [False])))
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(self.text_starts, self.start, "right") - 1
        self.bytes = b
        self._describe(texts)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return total[self.end] - total[self.start]

    def _describe(self, texts: list[str]) -> None:
        b, start, end = self.bytes, self.start, self.end
        n = end - start
        digits, upper, small, high = (self._sum(x[b]) for x in (_DIGIT, _UPPER, _SMALL, _HIGH))
        kind = _KIND[b]
        change = np.concatenate(([False], (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)))
        total = np.concatenate(([0], np.cumsum(change, dtype=np.int32)))
        self.switches = total[end] - total[np.minimum(start + 1, end)]
        letters = np.maximum(upper + small, 1)
        vowels = np.minimum(self._sum(_VOWEL[b]) * 4 // letters, 4)
        nibbles = self._sum(_NIBBLE[b]) == n
        length = np.searchsorted(_LENGTHS, n, "right")
        kinds = (1 * (digits > 0) + (upper > 0) * 2 + (small > 0) * 4 + (high > 0) * 8
                 + ~_RUN[b[start]] * 16)
        self.mixed = (n >= 16) & (digits > 0) & (letters > 0) & (self.switches >= 4)
        self.shape = length * 32 + kinds + 1
        self.change = (np.searchsorted([1, 2, 3, 4, 6, 9], self.switches, "right") * N_LENGTH
                       + length + 1)
        self.sound = (vowels + 5 * nibbles) * N_LENGTH + length + 1
        self.coarse = self._coarse(self.switches, n, (digits > 0) & (upper + small > 0))
        self.mark = np.where(n == 1, b[start] + 1, 0)
        before = np.concatenate(([-1], end[:-1]))
        # the run of tokens without a blank between them that a token stands in
        head = before != start
        if len(head):
            runs = np.flatnonzero(head)
            together = lambda x: np.add.reduceat(x, runs)
            rough = self._coarse(together(self.switches), together(n),
                                 (together(digits) > 0) & (together(upper + small) > 0))
            self.run = (2 * rough - 1)[np.cumsum(head) - 1] + ~head
            varied = (together(self.switches) >= 5) & (together(n) >= 16) & (
                together(digits) > 0) & (together(upper + small) > 0)
            self.random = 2 * varied[np.cumsum(head) - 1] + (
                (self.switches >= 3) & (n >= 16) & (digits > 0) & (letters > 0))
        else:
            self.run = self.random = np.empty(0, np.int64)
        after = np.concatenate((start[1:], [-1]))
        fresh = b[np.maximum(start - 1, 0)] == 10
        self.joint = (before == start) * 1 + (after == end) * 2 + (fresh | (start == 0)) * 4
        hashes = hash_spans(self.data.translate(LOWER), start, end)
        self.word = (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        self.own = np.where(n <= 12, self.word, 0)
        self.file = self._look(len(texts), digits, n)[self.text] * 2 + (length >= 5)

    @staticmethod
    def _coarse(switches: np.ndarray, n: np.ndarray, both: np.ndarray) -> np.ndarray:
        """How random a run of characters looks, in few steps (from 1)."""
        return (np.searchsorted([1, 3, 5], switches, "right") * 8
                + np.searchsorted([8, 16, 24], n, "right") * 2 + both + 1)

    def _look(self, n_texts: int, digits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How each text looks as a whole: share of digits, marks of code, size."""
        per = lambda x: np.bincount(self.text, x, n_texts)
        size = np.maximum(per(n), 1)
        code = per(np.isin(self.bytes[self.start], list(b"={};<>()[]\"'")))
        count = np.maximum(per(np.ones(len(n))), 1)
        return (np.searchsorted([0.01, 0.03, 0.1, 0.3], per(digits) / size, "right") * 20
                + np.searchsorted([0.01, 0.05, 0.15], code / count, "right") * 5
                + np.searchsorted([20, 100, 500, 3000], count, "right")).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def beside(self, values: np.ndarray, step: int, at: slice) -> np.ndarray:
        """The values of the tokens ``step`` away, 0 beyond the text."""
        index = np.arange(at.start, at.stop) + step
        inside = (index >= 0) & (index < len(self))
        index = np.clip(index, 0, len(self) - 1)
        return np.where(inside & (self.text[index] == self.text[at]), values[index], 0)

    def features(self, at: slice) -> list[np.ndarray]:
        """One feature number of each block for the tokens of a slice."""
        columns = [self.random[at], self.coarse[at], self.run[at], self.shape[at], self.change[at], self.sound[at], self.mark[at], self.joint[at],
                   self.file[at], self.own[at]]
        columns += [self.beside(self.word, step, at) for step in (-1, -2, -3, 1)]
        columns += [self.beside(self.shape, step, at) for step in (-1, 1)]
        return [column + start for column, start in zip(columns, STARTS)]

    def code_points(self) -> np.ndarray:
        """Code points before each byte of the data."""
        return np.concatenate(([0], np.cumsum((self.bytes & 0xC0) != 0x80)))

    def places(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of tokens from ``starts`` through ``ends`` in their text."""
        total = self.code_points()
        zero = total[self.text_starts[self.text[starts]]]
        return total[self.start[starts]] - zero, total[self.end[ends]] - zero


# ---------------------------------------------------------------- the field

def paths(unary: np.ndarray, pair: np.ndarray) -> list[int]:
    """The best tags of one chain that begins after and ends before an outside token."""
    if not len(unary):
        return []
    score = pair[OUT] + unary[0]
    back = []
    for t in range(1, len(unary)):
        ways = score[:, None] + pair
        back.append(ways.argmax(0))
        score = ways.max(0) + unary[t]
    tag = int((score + pair[:, OUT]).argmax())
    tags = [tag]
    for step in reversed(back):
        tags.append(tag := int(step[tag]))
    return tags[::-1]


def surely_outside(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Tokens that are outside on every best path: making such a token outside, and the
    one after it a beginning if it was inside, gains more than any transitions can cost."""
    worst = 0.0
    for before in range(3):
        for tag in (BEGIN, INSIDE):
            for after in range(3):
                ways = [pair[OUT, OUT]] if after == OUT else [pair[OUT, BEGIN]]
                if pair[before, tag] > BARRED / 2 and pair[tag, after] > BARRED / 2:
                    worst = max(worst, pair[before, tag] + pair[tag, after]
                                - pair[before, OUT] - max(ways))
    tail = max(0.0, (pair[INSIDE] - pair[BEGIN]).max())
    later = np.maximum(0, unary[:, INSIDE] - unary[:, BEGIN]) + tail
    later = np.concatenate((later[1:], [0.0]))
    gain = unary[:, OUT] - unary[:, 1:].max(1) if len(unary) else np.empty(0)
    return gain > worst + later + 1e-9


def decode(unary: np.ndarray, pair: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The best tags of chains laid end to end."""
    tags = np.zeros(len(unary), np.int8)
    open_ = np.flatnonzero(~surely_outside(unary, pair))
    if len(open_):
        breaks = np.flatnonzero((np.diff(open_) > 1) | (np.diff(chain[open_]) != 0)) + 1
        for island in np.split(open_, breaks):
            tags[island] = paths(unary[island], pair)
    return tags


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def expected(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray):
    """Marginals of tags (chains x steps x 3) and of neighbouring tags (3 x 3, summed; the
    outside before and after a chain included), and the log of the normaliser."""
    n, steps, _ = unary.shape
    live = np.arange(steps) < sizes[:, None]
    ahead = np.empty_like(unary)
    ahead[:, 0] = pair[OUT] + unary[:, 0]
    for t in range(1, steps):
        new = log_sum(ahead[:, t - 1, :, None] + pair, 1) + unary[:, t]
        ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
    norm = log_sum(ahead[:, -1] + pair[:, OUT], 1)
    behind = np.empty_like(unary)
    behind[:, -1] = pair[:, OUT]
    for t in range(steps - 2, -1, -1):
        new = log_sum(pair + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(live[:, t + 1, None], new, pair[:, OUT])
    tags = np.exp(ahead + behind - norm[:, None, None]) * live[..., None]
    both = (ahead[:, :-1, :, None] + pair + (unary + behind)[:, 1:, None, :] - norm[:, None, None, None])
    pairs = (np.exp(both) * live[:, 1:, None, None]).sum((0, 1))
    pairs[OUT] += tags[:, 0].sum(0)
    pairs[:, OUT] += np.exp(ahead[:, -1] + pair[:, OUT] - norm[:, None]).sum(0)
    return tags, pairs, norm


@dataclass(frozen=True)
class Model:
    """Scores of begin and inside over outside per feature, and of neighbouring tags."""

    weights: np.ndarray
    pair: np.ndarray

    def unary(self, features: list[np.ndarray]) -> np.ndarray:
        """Scores of the tags; both weights of a feature are looked up as one number."""
        weights = self.weights[:, 0] + 1j * self.weights[:, 1]
        total = sum(weights[column] for column in features)
        return np.stack((np.zeros(len(total)), total.real, total.imag), 1)

    def tags(self, tokens: Tokens, slab: int) -> np.ndarray:
        n = len(tokens)
        unary = [self.unary(tokens.features(slice(at, min(n, at + slab)))) for at in range(0, n, slab)]
        return decode(np.concatenate(unary), self.pair, tokens.text) if unary else np.empty(0, np.int8)

    def spans(self, texts: list[str], settings: Settings) -> list[list[tuple[int, int]]]:
        """Spans of begin-inside runs in each text, in code points."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        tokens = Tokens(texts)
        tags = self.tags(tokens, settings.slab)
        first = np.flatnonzero(tags == BEGIN)
        if len(first):
            stop = np.flatnonzero(np.concatenate((tags[1:] != INSIDE, [True])))
            last = stop[np.searchsorted(stop, first)]
            for text, a, b in zip(tokens.text[first], *tokens.places(first, last)):
                if b - a >= settings.min_chars:
                    found[text].append((int(a), int(b)))
        return found


def window_rows(text: str, settings: Settings) -> list[tuple[bytes, bytes, bool]]:
    """Windows of a text to learn from: features, tags and whether a secret is inside. A text
    with base spans gives the surroundings of each; one without gives those of its longest
    token and of one picked by a hash."""
    tokens, n = Tokens([text]), settings.around
    if not len(tokens):
        return []
    total = tokens.code_points()
    tags = np.zeros(len(tokens), np.int8)
    windows, until = [], 0
    for start, end in sorted((s, e) for _, _, e, s in base_spans(text)):
        inside = np.flatnonzero((total[tokens.start] < end) & (total[tokens.end] > max(start, until)))
        until = max(until, end)
        if len(inside):
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
            windows.append((inside[0] - n, inside[-1] + n + 1))
    if not windows:
        picked = int(hashlib.md5(tokens.data).hexdigest()[:8], 16) % len(tokens)
        longest = int(np.where(tokens.mixed, 0, tokens.end - tokens.start).argmax())
        windows = [(middle - n, middle + n + 1) for middle in {picked, longest}]
    rows = []
    for a, b in windows:
        at = slice(max(0, a), min(len(tokens), b, max(0, a) + 6 * n))
        if not (tokens.mixed[at] & (tags[at] == OUT)).any():
            features = np.stack(tokens.features(at), 1).astype("<i4")
            rows.append((features.tobytes(), tags[at].tobytes(), bool(tags[at].any())))
    return rows


def fit(rows: list[tuple[bytes, bytes]], settings: Settings) -> Model:
    """Weights by gradient ascent on the likelihood (Adam)."""
    features = [np.frombuffer(f, "<i4").reshape(-1, len(BLOCKS)) for f, _ in rows]
    tags = [np.frombuffer(t, np.int8) for _, t in rows]
    for f, t in [x for x in zip(features, tags) if x[1].any()]:
        for without in (WORDS_BESIDE, EXACT, WORDS_BESIDE + EXACT):
            bare = f.copy()
            bare[:, without] = STARTS[list(without)]
            features.append(bare)
            tags.append(t)
    sizes = np.array([len(t) for t in tags])
    shape = len(tags), sizes.max()
    live = np.arange(shape[1]) < sizes[:, None]
    x, y = np.concatenate(features), np.concatenate(tags)
    truth = np.zeros((*shape, 3))
    truth[live] = np.eye(3)[y]
    padded = np.full((shape[0], shape[1] + 2), OUT)
    padded[:, 1:-1][live] = y
    observed = np.zeros((3, 3))
    for size in np.unique(sizes):
        some = padded[sizes == size][:, :size + 2]
        np.add.at(observed, (some[:, :-1].ravel(), some[:, 1:].ravel()), 1)
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = BARRED
    n_weights = 2 * STARTS[-1]
    theta = np.zeros(n_weights + 9)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.rounds + 1):
        model = Model(theta[:n_weights].reshape(-1, 2), theta[n_weights:].reshape(3, 3) + barred)
        unary = np.zeros((*shape, 3))
        unary[live] = model.unary(list(x.T))
        marginal, pairs, _ = expected(unary, model.pair, sizes)
        error = (truth - marginal)[live][:, 1:]
        gradient = np.empty_like(theta)
        for tag in range(2):
            gradient[tag:n_weights:2] = np.bincount(
                x.ravel(), np.repeat(error[:, tag], x.shape[1]), STARTS[-1])
        gradient[n_weights:] = np.where(barred < 0, 0, observed - pairs).ravel()
        gradient = gradient / shape[0] - settings.ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        theta += settings.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:n_weights].reshape(-1, 2).copy(), theta[n_weights:].reshape(3, 3) + barred)


def train(documents: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
          text_col: str = "text") -> Model | None:
    """The field learned from a bounded sample, or None if it holds no base span."""
    n, space = documents.count(), 1 << 31
    share = max(1, space * settings.sample_docs // max(n, 1))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.length(text_col))
    texts = (documents.filter(F.pmod(key, F.lit(space)) < share)
             .select(F.col(text_col).alias("text")).dropna())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("features", pa.binary()), ("tags", pa.binary()), ("secret", pa.bool_())])
        for batch in pieces(batches, 256):
            rows = [r for t in batch.column(0).to_pylist() for r in window_rows(t, settings)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, r)) for r in rows], schema)

    found = texts.mapInArrow(windows, "features binary, tags binary, secret boolean").dropDuplicates()
    rows = []
    for secret in (True, False):
        picked = (found.filter(F.col("secret") == secret).select("features", "tags")
                  .orderBy(F.xxhash64("features"), "features").limit(settings.max_windows).collect())
        if not picked:
            return None
        rows += [(bytes(r.features), bytes(r.tags)) for r in picked]
    return fit(rows, settings)


# ---------------------------------------------------------------- scan

def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(texts: list[str], model: Model | None, settings: Settings) -> list[tuple]:
    """Per text: base spans and all spans, each as (start, kind, end) in order."""
    bases = [[(s, k, e) for s, k, e, _ in base_spans(t)] for t in texts]
    if model is None:
        return [(b, b) for b in bases]
    out = []
    for base, more in zip(bases, model.spans(texts, settings)):
        free = [(a, 3, b) for a, b in more if not any(a < e and s < b for s, _, e in base)]
        out.append((base, sorted(base + free)))
    return out


def scan(documents: DataFrame, model: Model | None, settings: Settings = Settings(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts and hash of the base spans, and ``spans`` of every row."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"]
    schema = (f"doc_id {documents.schema[id_col].dataType.simpleString()}, n_assign long, n_access long,"
              " n_hex long, base_sha256 string, spans string, n_field long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = scanned(texts, model, settings)
            count = lambda kind: pa.array(
                [sum(k == kind for _, k, _ in spans) for _, spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), count(0), count(1), count(2),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                pa.array([joined(s) for _, s in found]), count(3)], names)

    return slim.mapInArrow(each, schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan(documents, train(documents))
