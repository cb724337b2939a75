"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: words and stems (openings of words) that labelled toxic
documents hold far more often than others; copies and near copies among the training
rows count once. A word of a text that is not in the lexicon
is matched by running its Levenshtein automaton over the lexicon trie, so misspelled
terms of any length, and misspelled openings on a stem, are found too. Every hit is then read in its context: hits in quotation marks or
after a reporting verb count apart from direct ones, and hits close together count
more. A logistic model over these counts gives the score.

Training uses a bounded sample of labelled rows (``Settings.max_train``), never rows of
the held-out fold; corpus texts are scored in one pass without a shuffle.

Defined results: NULL and empty texts score like texts without hits. Labels that are
NULL are not used; of repeated labels the larger counts. Without labels of both kinds
the score is the share of toxic labels (0.5 without any). Repeated ids and rows are
scored one by one. Rows without an id are never held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import durable, pieces, table
from riskmart.llm.near_dedup import permutation_seeds, shingle_hashes, signature

WORD = re.compile(r"\w+")
STRETCHED = re.compile(r"(\w)\1{2,}")

# Verbs that report speech, in the four languages of the corpus.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quote dit disait écrit appelé sagte sagt"
    " schrieb nannte dijo dice escribió llamó".split())
OPENING, CLOSING = "«“„‹", "»”‟›"


@dataclass(frozen=True)
class Settings:
    max_train: int = 8000
    min_documents: int = 4
    min_precision: float = 0.5
    shingle: int = 3
    alike: float = 0.5
    significance: float = 0.01
    stem_lengths: tuple[int, ...] = (4, 5)
    context: int = 8
    ridge: float = 1.0


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder that decides the fold; NULL ids fall in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, keep: Column,
                  max_train: int) -> DataFrame:
    """Texts and labels of a sample of about ``max_train`` labelled rows at most. The
    sample is broadcast, as that parameter bounds it."""
    labelled = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
                .groupBy("doc_id").agg(F.max(label).alias("label")))
    n = labelled.count()
    if n > max_train:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        labelled = labelled.filter(part < int(max_train / n * (1 << 20)))
    slim = documents.select(F.col("doc_id"), F.col("text"))
    return slim.join(F.broadcast(labelled), "doc_id").select("text", F.col("label").cast("int"))


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(STRETCHED.sub(r"\1", text.lower()))


def _cuts(word: str) -> set[str]:
    """The word, and the word without one of its letters."""
    return {word, *(word[:i] + word[i + 1:] for i in range(len(word)))}


class Lexicon:
    """Terms and stems in a trie, and the words near them: one letter wrong, missing or
    too many, or two neighbours swapped, in the whole term or in the letters of the stem.
    Terms of fewer than ``shortest`` letters are only met as they are."""

    def __init__(self, terms: set[str], stems: set[str], ignored: set[str] = frozenset(), shortest: int = 5):
        self.terms, self.stems, self.ignored = terms, stems, ignored
        self.stem_sizes = sorted({len(s) for s in stems})
        self.trie: dict = {}
        # words one edit apart are equal, or become equal by cutting a letter of one or both
        self.cuts: set[str] = set()
        self.stem_cuts: set[str] = set()
        for word, end, cuts in (*((t, "", self.cuts) for t in terms if len(t) >= shortest),
                                *((s, "*", self.stem_cuts) for s in stems)):
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[end] = word
            cuts |= _cuts(word)
        #: the same by length for the first letters of terms and stems, and openings of
        #: words that were held against them
        self.heads: dict[int, set[str]] = {}
        for word in (*(t for t in terms if len(t) >= shortest), *stems):
            self.heads.setdefault(min(4, len(word)), set()).update(_cuts(word[:4]))
        self.openings: dict[str, bool] = {}
        self.known: dict[str, str | None] = {}

    def opens(self, start: str) -> bool:
        """Whether a word that opens with these five letters can be near anything."""
        found = self.openings.get(start)
        if found is None:
            found = self.openings[start] = any(
                not cuts.isdisjoint(_cuts(start[:k]) | _cuts(start[:k + 1])) for k, cuts in self.heads.items())
        return found

    def near(self, word: str) -> str | None:
        """A term one edit away from the word, or a stem one edit away from its opening:
        the automaton's states are rows of edit distances, and branches of the trie on
        which every state is dead are left."""
        stack = [(self.trie, [*range(len(word) + 1)], [], "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c in ("", "*"):
                    if (min(row) if c else row[-1]) <= 1:
                        return child
                    continue
                fresh = [row[0] + 1]
                for i, w in enumerate(word):
                    fresh.append(min(fresh[-1] + 1, row[i + 1] + 1, row[i] + (w != c)))
                    if before and i and w == last and word[i - 1] == c:
                        fresh[-1] = min(fresh[-1], before[i - 1] + 1)
                if min(fresh) <= 1:
                    stack.append((child, fresh, row, c))
        return None

    def match(self, word: str) -> str | None:
        """``t`` for a term, ``s`` for a word on a stem, ``n`` near one of them, else None."""
        if word in self.terms:
            return "t"
        if not self.opens(word[:5]):
            return None
        if any(word[:k] in self.stems for k in self.stem_sizes):
            return "s"
        if word not in self.ignored and (
                not self.cuts.isdisjoint(_cuts(word))
                or any(not self.stem_cuts.isdisjoint(_cuts(word[:k]) | _cuts(word[:k + 1])) for k in self.stem_sizes)):
            return "n" if self.near(word) else None
        return None

    def kinds(self, distinct: set[str]) -> dict[str, str]:
        """The kinds of those words that match; remembers words between batches."""
        if len(self.known) > 300_000:
            self.known.clear()
            self.openings.clear()
        found = {}
        for word in distinct:
            kind = self.known.get(word, "")
            if kind == "":
                kind = self.known[word] = self.match(word)
            if kind:
                found[word] = kind
        return found


def quoted(text: str, start: int, before: list[str]) -> bool:
    """Whether the hit at ``start`` is reported: within quotation marks of its line, or
    after a reporting verb."""
    line = text[text.rfind("\n", 0, start) + 1:start]
    if line.count('"') % 2:
        return True
    if sum(map(line.count, OPENING)) > sum(map(line.count, CLOSING)):
        return True
    return not REPORTING.isdisjoint(before)


def features(text: str | None, lexicon: Lexicon, context: int) -> list[float]:
    """What the model reads of a text."""
    words = tokens(text)
    kinds = lexicon.kinds(set(words))
    if not kinds:
        return [0.0] * 6
    counts, places = Counter(), []
    smooth = STRETCHED.sub(r"\1", text.lower())
    for i, match in enumerate(WORD.finditer(smooth)):
        kind = kinds.get(match.group())
        if kind:
            reported = quoted(smooth, match.start(), words[max(0, i - context):i])
            counts["q" if reported else kind] += 1
            places.append(i)
    at = np.array(places)
    dense = (np.searchsorted(at, at + 2 * context) - np.arange(len(at))).max()
    return [math.log1p(counts["t"]), math.log1p(counts["s"]), math.log1p(counts["n"]),
            math.log1p(counts["q"]), math.log1p(dense - 1), min(1.0, 20 * len(places) / len(words))]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for n draws."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs) if top > -700 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def near_copies(rows: DataFrame, settings: Settings) -> tuple[dict[int, int], list[int]]:
    """Classes of training rows whose MinHash signatures are alike: the class of a text
    by its hash, for texts that are not alone in theirs; and how many other and toxic
    rows are more than one of their kind in a class. The signatures of the sample, 256
    bytes a row, go to the driver."""
    seeds, size = permutation_seeds(64), settings.shingle

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            signed = [(k, signature(keys, seeds).tobytes(), y > 0) for k, y, keys in
                      ((k, y, shingle_hashes(t, size)) for t, y, k in zip(*(c.to_pylist() for c in batch.columns)))
                      if len(keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in signed], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.bool_()))],
                ["key", "signature", "toxic"])

    signed = sorted(map(tuple, rows.select("text", "label", F.xxhash64("text")).mapInArrow(
        sign, "key long, signature binary, toxic boolean").collect()))
    first: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
    classes: dict[int, int] = {}
    for key, data, _ in signed:
        if key in classes:
            continue
        own, bands = np.frombuffer(data, np.uint32), [(at, data[at:at + 8]) for at in range(0, len(data), 8)]
        heads = {first[b][0]: first[b][1] for b in bands if b in first}
        classes[key] = next((k for k, head in heads.items() if (head == own).mean() >= settings.alike), key)
        if classes[key] == key:
            for band in bands:
                first.setdefault(band, (key, own))
    sizes = Counter(classes[key] for key, *_ in signed)
    kinds = Counter((classes[key], toxic) for key, _, toxic in signed)
    spare = [sum(n - 1 for (_, toxic), n in kinds.items() if toxic == one) for one in (False, True)]
    return {key: c for key, c in classes.items() if sizes[c] > 1}, spare


def _term_counts(rows: DataFrame, of, classes: dict[int, int]) -> DataFrame:
    """How many toxic and other rows hold each term that ``of`` gives for a text; near
    copies of one kind count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            tallies, shared = (Counter(), Counter()), (set(), set())
            for text, label, key in zip(*(c.to_pylist() for c in batch.columns)):
                if key in classes:
                    shared[label > 0].update((t, classes[key]) for t in of(text))
                else:
                    tallies[label > 0].update(of(text))
            found = [(t, None, tallies[1][t], tallies[0][t]) for t in tallies[0].keys() | tallies[1].keys()]
            found += [(*x, int(x in shared[1]), int(x in shared[0])) for x in shared[0] | shared[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["term", "class", "a", "b"])

    once = lambda c: F.when(F.col("class").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c)
    return (rows.select("text", "label", F.xxhash64("text")).mapInArrow(count, "term string, class long, a long, b long")
            .groupBy("term", "class").agg(once("a"), once("b"))
            .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def learn_lexicon(rows: DataFrame, n_toxic: int, n_other: int, settings: Settings) -> Lexicon:
    """Terms and stems that toxic rows hold significantly more often, near copies aside."""
    sizes = settings.stem_lengths
    classes, spare = near_copies(rows, settings)

    def parts(text: str | None) -> set[str]:
        found = {w for w in tokens(text) if len(w) > 2 and not w.isdigit()}
        return found | {f"{w[:k]}*" for w in found for k in sizes if len(w) >= k + 2}

    counts = _term_counts(rows, parts, classes).filter(F.col("a") + F.col("b") >= settings.min_documents)
    counts = durable(counts)
    tried = max(1, counts.count())
    base = (n_toxic - spare[1]) / (n_toxic + n_other - sum(spare))

    def significant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(
                [binomial_tail(a, a + b, base) * tried < settings.significance
                 for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.bool_()))

    strong = (counts.filter((F.col("a") >= settings.min_documents)
                            & (F.col("a") >= settings.min_precision * (F.col("a") + F.col("b"))))
              .mapInArrow(significant, counts.schema))
    good = {r.term for r in strong.collect()}
    terms = {t for t in good if not t.endswith("*")}
    stems = {t[:-1] for t in good if t.endswith("*")}
    # a stem that only repeats one whole word adds nothing but false hits
    stems = {s for s in stems if not any(t.startswith(s) for t in terms if len(t) <= len(s) + 6)
             or sum(t.startswith(s) for t in terms) > 2}
    stems = {s for s in stems if not any(s[:k] in stems for k in sizes if k < len(s))}
    draft = Lexicon(terms, stems, shortest=1)

    def close(text: str | None) -> set[str]:
        return {w for w, kind in draft.kinds(set(tokens(text))).items() if kind == "n"}

    harmless = (_term_counts(rows, close, classes)
                .filter((F.col("b") > 0) & (F.col("a") < settings.min_precision * (F.col("a") + F.col("b"))))
                .select("term").collect())
    return Lexicon(terms, stems, {r.term for r in harmless}, shortest=1)


def train(documents: DataFrame, labels: DataFrame, keep: Column,
          settings: Settings = Settings(), label: str = "toxic"):
    """The lexicon and the weights."""
    rows = durable(training_rows(documents, labels, label, keep, settings.max_train))
    tally = {r["label"]: r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    n_toxic, n_other = tally.get(1, 0), tally.get(0, 0)
    if not n_toxic or not n_other:
        share = (n_toxic or n_other) and n_toxic / (n_toxic + n_other)
        share = min(max(share if n_toxic + n_other else 0.5, 0.001), 0.999)
        return Lexicon(set(), set()), np.array([0.0] * 6 + [math.log(share / (1 - share))])
    lexicon = learn_lexicon(rows, n_toxic, n_other, settings)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t, lexicon, settings.context) for t in batch.column(0).to_pylist()],
                          pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    sample = rows.mapInArrow(read, "x array<double>, label int").collect()
    x, y = np.array([r.x for r in sample]), np.array([float(r.label > 0) for r in sample])
    return lexicon, logistic(x, y, settings.ridge)


def score(documents: DataFrame, lexicon: Lexicon, weights: np.ndarray,
          settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, score double"
    size = settings.context

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t, lexicon, size) for t in batch.column(1).to_pylist()])
            z = x.reshape(-1, 6) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return slim.mapInArrow(rate, schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, weights = train(documents, labels, fold(F.col("doc_id"), 5) != 0)
    return score(documents, lexicon, weights).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
