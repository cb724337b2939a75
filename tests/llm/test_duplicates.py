"""Substring and near-duplicate removal and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from conftest import word
from riskmart.llm import common, components, decontamination, near_dedup, substring_dedup

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPLIT.split(text or "") if w]


def test_word_hashes_are_those_of_the_words():
    text = "a  bb\tcc bb \x0b é a\nbb cc"
    parts, hashes = common.split_words(text), common.text_hashes(text)
    assert len(parts) == len(hashes)
    assert all((p == q) == (h == k) for p, h in zip(parts, hashes) for q, k in zip(parts, hashes))
    windows = common.hash_windows(hashes, 2)
    assert windows[1] == windows[-1] and len(set(windows)) == len(windows) - 2


@pytest.mark.parametrize("period", range(1, 10))
def test_difference_cover_aligns_all_shifts(period):
    cover = substring_dedup.difference_cover(period)
    for a in range(period):
        for b in range(period):
            assert any((a + k) % period in cover and (b + k) % period in cover for k in range(period))


def removed(rows, size=13):
    first = {}
    for doc, text, *_ in rows:
        words = split(text)
        for i in range(len(words) - size + 1):
            key = tuple(words[i:i + size])
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, text, *_ in rows:
        words = split(text)
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i:i + size])] < doc:
                gone.update(range(i, i + size))
        out[doc] = [w for i, w in enumerate(words) if i not in gone], len(gone)
    return out


@pytest.mark.parametrize("size", [7, 13, 20])
def test_passages_against_brute_force(frame, rows, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)  # several blocks
    expected = removed(rows, size)
    found = substring_dedup.mark_repeats(frame(rows), size=size).collect()
    assert {r.doc_id: (r.kept_text.split(), r.n_removed) for r in found} == expected
    for r in found:
        assert r.kept_sha256 == hashlib.sha256(" ".join(expected[r.doc_id][0]).encode()).hexdigest()


def groups(rows, size, percent=80):
    sets = {}
    for doc, text, *_ in rows:
        words = split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[doc] = {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_against_all_pairs(frame, rows, size):
    found = near_dedup.classes(frame(rows), settings=near_dedup.Settings(shingle=size)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_dense_group_loses_no_link(frame):
    """Variants of one text, some near the threshold, over every step of the search."""
    rng = random.Random(5)
    base = [word(rng) for _ in range(60)]
    rows = []
    for doc in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(60)] = word(rng)
        rows.append((doc, " ".join(words), "en", "s", 1))
    found = near_dedup.classes(frame(rows), settings=near_dedup.Settings(shingle=2, centres=1)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows, 2)


def test_sequential_test_keeps_likely_pairs():
    settings = near_dedup.Settings()
    table = near_dedup.least_matches(settings)
    assert [n for n, _ in table] == list(range(16, 129, 16))
    assert all(0.4 < m / n < 0.8 for n, m in table[1:])
    rng = np.random.default_rng(3)
    for n, least in table:
        assert (rng.binomial(n, 0.8, 20000) < least).mean() < 1e-3


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


ITEMS = [(1, "What is the capital of the small country by the sea today?"), (2, "Short one."),
         (10, "what IS the capital: of the small country by the lake today"), (3, None), (4, "..."), (None, "no id here")]


def windows(text):
    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found


def hits(text, size=10):
    words, bad, names = windows(text), set(), set()
    for item, item_text in ITEMS:
        own = windows(item_text)
        k = min(size, len(own))
        known = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in known:
                bad.update(range(i, i + k))
                if item is not None:
                    names.add(str(item))
    return len(words), len(bad), sorted(names)


TEXTS = ["x what is the capital of the small country by the sea today y", "a short-one b", "nothing", "", None,
         "What is the capital of the small country by", "what is the capital of the small country by the lake", "No ID here"]


@pytest.mark.parametrize("limit", [64 << 20, 60])  # in one piece, and in blocks
def test_decontamination(frame, limit):
    docs = frame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)])
    items = frame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.scan(docs, items, max_broadcast_bytes=limit).collect()}
    for i, text in enumerate(TEXTS):
        n, bad, names = hits(text)
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, bad, len(names), bad > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    kept = {r.doc_id for r in decontamination.remove_documents(docs, items, max_broadcast_bytes=limit).collect()}
    assert kept == {i for i, t in enumerate(TEXTS) if not hits(t)[1]}
    spans = {r.doc_id: r.text for r in decontamination.remove_spans(docs, items, max_broadcast_bytes=limit).collect()}
    assert spans[0].split() == ["x", "y"] and spans[2] == "nothing" and spans[4] is None
    assert all(not hits(t)[1] for t in spans.values())


def test_odd_rows(odd, nothing, frame):
    items = frame(ITEMS, "item_id long, text string")
    n = odd.count()
    assert decontamination.scan(odd, items).count() == n
    assert decontamination.remove_documents(odd, items).columns == odd.columns
    assert decontamination.scan(odd, items.limit(0)).filter("contaminated").count() == 0
    marked = substring_dedup.mark_repeats(odd).collect()
    assert len(marked) == n
    assert all(r.n_removed == 0 for r in marked if r.doc_id is None)
    found = near_dedup.classes(odd).collect()
    assert len(found) == n and all(r.kept for r in found if r.doc_id is None)
    assert near_dedup.one_of_each(odd).columns == odd.columns
    for made in (decontamination.scan(nothing, items), substring_dedup.mark_repeats(nothing), near_dedup.classes(nothing)):
        assert made.count() == 0
