"""Toxicity, line quality, page text and mixing: held-out accuracy, brute force, odd rows."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sentence, word
from riskmart.llm import html_text, mixing, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(1)
    terms = {word(rng) for _ in range(40)} | {"moron", "disgusting"}
    lexicon = toxicity.Lexicon(terms, set())
    long_terms = [t for t in terms if len(t) >= 5]
    words = [word(rng) for _ in range(300)]
    for term in long_terms:  # and misspellings of the terms
        k = rng.randrange(len(term))
        words += [term[:k] + term[k + 1:], term[:k] + "z" + term[k:], term[:k] + "q" + term[k + 1:]]
    for w in words:
        if w in terms:
            assert lexicon.match(w) == "t"
        elif len(w) >= 4:
            assert (lexicon.match(w) == "n") == any(distance(w, t) <= 1 for t in long_terms), w


def test_misspelled_stems_short_terms_and_swapped_letters_are_near():
    lexicon = toxicity.Lexicon({"idiot", "idiots", "scum"}, {"idio"}, {"sum"}, shortest=1)
    assert [lexicon.match(w) for w in ("idiot", "idiotic", "scum")] == ["t", "s", "t"]
    near = "ldiot 1diot idjot idoit ldiotic dioticly iidiotic scvm scu scmu sscum".split()
    assert [w for w in near if lexicon.match(w) != "n"] == []
    assert [w for w in ("sum", "radish", "scab", "of", "") if lexicon.match(w)] == []


def test_learned_lexicon_meets_misspelled_terms(frame):
    insults = ["idiot", "idiots", "idiotic", "idiocy", "scum"]
    rng = random.Random(3)
    texts = [(i, " ".join(rng.sample([*(sentence(rng, 1)[:-1] for _ in range(6)), *(insults if i % 2 else ())], 6)), i % 2)
             for i in range(400)]
    rows = frame([(t, y) for _, t, y in texts], "text string, label int")
    lexicon = toxicity.learn_lexicon(rows, 200, 200, toxicity.Settings())
    assert {"idiot", "scum"} <= lexicon.terms and "idio" in lexicon.stems
    assert [w for w in ("ldiot", "1diot", "idjot", "idoitic", "scvm") if lexicon.match(w) != "n"] == []


def test_fixed_phrases_are_learned_and_copies_are_not(frame):
    rng = random.Random(5)
    clean = [sentence(rng, 30) for _ in range(300)]
    toxic = [f"{sentence(rng, 12)} utter rubbish {sentence(rng, 12)}" for _ in range(100)]
    copied = [f"gardening calendar tomatoes {sentence(rng, 1)} spinach watering {toxic[0]}" for _ in range(30)]
    rows = frame([*((t, 0) for t in clean), *((t, 1) for t in toxic + copied * 2)], "text string, label int")
    lexicon = toxicity.learn_lexicon(rows, 160, 300, toxicity.Settings())
    assert {"utter", "rubbish"} <= lexicon.terms
    assert not {"gardening", "calendar", "tomatoes", "spinach", "watering"} & lexicon.terms


def test_rare_terms_are_learned_beside_much_frequent_noise(frame):
    """2100 words in more toxic rows than the term, none of them significant."""
    noise = " ".join(f"no{i:04}se" for i in range(2100))
    rows = frame([*((f"{noise} a{i}", 1) for i in range(60)), *((f"{noise} b{i}", 0) for i in range(50)),
                  *((f"wretched c{i} d{i} e{i} f{i}", 1) for i in range(40)),
                  *((f"g{i} h{i} k{i} l{i}", 0) for i in range(50))], "text string, label int")
    apart = toxicity.Settings(alike=1.1)
    assert "wretched" in toxicity.learn_lexicon(rows, 100, 100, apart).terms


def test_quoted_hits_count_apart():
    lexicon = toxicity.Lexicon({"moron"}, {"idio"})
    direct = toxicity.features("you are a moron and an idiotic moronn", lexicon, 8)
    reported = toxicity.features('he said "you are a moron" to them', lexicon, 8)
    assert direct[:4] == [math.log1p(1)] * 3 + [0.0]
    assert reported[0] == 0 and reported[3] == math.log1p(1)
    assert toxicity.features("", lexicon, 8) == toxicity.features(None, lexicon, 8) == [0.0] * 6


def held_out(spark, module, label, folds, out):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = module.query(spark, SF)
    assert found.count() == documents.count()
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert all((__import__("zlib").crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return np.mean([r.predicted == r[label] for r in rows])


def test_toxicity_on_held_out_rows(spark):
    assert held_out(spark, toxicity, "toxic", 5, 0) >= 0.97


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, quality_classifier, "quality", 3, 1) >= 0.97


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    unary, pair = rng.normal(size=8), rng.normal(size=(2, 2))
    found = quality_classifier.marginals(unary, pair, quality_classifier.Padded(lengths))[0]
    at = 0
    for n in lengths:
        weights = np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            s = sum(unary[at + i] for i, y in enumerate(labels) if y)
            s += sum(pair[a, b] for a, b in zip(labels, labels[1:]))
            for i, y in enumerate(labels):
                weights[i, y] += math.exp(s)
        assert np.allclose(found[at:at + n], np.log(weights[:, 1] / weights[:, 0]))
        at += n


def cut_value(odds, edges, kept):
    return (sum(o for o, k in zip(odds, kept) if o > 0 and not k) + sum(-o for o, k in zip(odds, kept) if o < 0 and k)
            + sum(w for a, b, w in edges if kept[a] != kept[b]))


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, i + 1, rng.random()) for i in range(n - 1)]
        edges += [(a, b, rng.random()) for a in range(n) for b in range(a + 2, n) if rng.random() < 0.3]
        best = min(cut_value(odds, edges, k) for k in itertools.product((False, True), repeat=n))
        assert abs(cut_value(odds, edges, html_text.min_cut(odds, edges)) - best) < 1e-6


def page(rng, body):
    menu = "".join(f'<li><a href="/{i}">{word(rng)}</a></li>' for i in range(6))
    return (f'<html><head><title>t</title><script>var x = "<p>no</p>";</script><style>p {{}}</style></head><body>'
            f'<header class="site-header"><h2>The {word(rng)} site</h2></header><nav><ul>{menu}</ul></nav>'
            f'<div class="cookie-notice">We use cookies. Accept all of them to go on reading here.</div>{body}'
            f'<aside class="sidebar"><h3>Related</h3><p>{sentence(rng, 12)}</p></aside>'
            f'<div id="comments"><p>{sentence(rng, 25)}</p><form><input name="q"><label>Your reply</label></form></div>'
            f'<div class="ad-banner">{sentence(rng, 9)}</div><footer>&copy; all rights reserved</footer></body></html>')


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"),
                                          ('<div class="post-content">', "</div>"), ('<div id="story">', "</div>")])
def test_main_text(open_, close):
    rng = random.Random(7)
    for _ in range(10):
        text = [sentence(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
        body = open_ + "".join(f"<p>{t}</p>" for t in text) + close
        assert html_text.extract(page(rng, body)) == "\n".join(text)


def test_broken_markup_and_references():
    assert html_text.extract("<article><p><b>One &amp two &lt;x&gt;<br><p>Three\n  &eacute;t&#233; four five six.") == (
        "One & two <x>\nThree été four five six.")
    assert html_text.extract("<article><p>A first sentence of the text.</p><p>cut <a href='x") .startswith("A first sentence")
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html><script>x") == ""


@pytest.mark.parametrize("skipped", [
    "<script>for(i=0;i<n;i++)f(i);</script>", "<SCRIPT>if(a<b&&c)d='<p \"';</Script >", "<style>a<b{}</style>",
    "<script>x='</scripts>';y='<script>'</script>", "<svg><svg><text>no</text></svg><text>nor this</text></svg>",
    "<object><svg/><object><p>no</p></object><p>no text of the article.</p></object>", "<svg><svg><text>no</text></svg>",
    "<template><!-- </template> --><p>This is no text of the article at all.</p></template>"])
def test_skipped_elements_end_at_their_closing_tag(skipped):
    rng = random.Random(9)
    text = [sentence(rng, 20) for _ in range(3)]
    body = "".join(f"<p>{t}</p>" for t in text)
    assert html_text.extract(f"<html><head>{skipped}</head><body><article>{body}</article></body></html>") == "\n".join(text)
    assert html_text.extract(f"<article>{body}{skipped}{body}</article>{skipped}") == "\n".join(text * 2)


def test_raking_meets_the_targets():
    rng = np.random.default_rng(1)
    cells = [rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 5, 60)]
    tokens = rng.integers(1, 1000, 60).astype(float)
    targets = [rng.dirichlet(np.ones(k)) * 0.5 + np.bincount(c, tokens, k) / tokens.sum() * 0.5
               for c, k in zip(cells, (4, 3, 5))]
    weight = mixing.rake(tokens, cells, targets, 500, 1e-12)
    for c, t in zip(cells, targets):
        assert np.allclose(np.bincount(c, weight * tokens, len(t)) / tokens.sum(), t, atol=1e-6)
    p = mixing.probabilities(tokens, weight, 0.6 * tokens.sum())
    assert p.max() <= 1 and abs((p * tokens).sum() - 0.6 * tokens.sum()) < 1e-6 * tokens.sum()


def test_mix_draws_by_its_probabilities(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(documents)
    total = found.agg(F.sum("tokens"), F.sum(F.when(F.col("selected"), F.col("tokens"))),
                      F.sum(F.col("tokens") * F.col("probability"))).first()
    assert found.count() == documents.count()
    assert abs(total[2] / total[0] - 0.5) < 1e-6 and abs(total[1] / total[0] - 0.5) < 0.03
    assert mixing.drawn(documents).columns[:5] == documents.columns
    few = mixing.Settings(max_sources=3, max_languages=2)
    assert mixing.mix(documents, settings=few).count() == documents.count()


def test_many_sources_are_raked_one_by_one(frame):
    """More sources than are raked on the driver: none is merged, named ones keep their target."""
    texts = [(i, "word " * (1 + i % 3), "en", f"s{i}", 1) for i in range(1100)]
    rows = mixing.mix(frame(texts)).collect()
    roots = sum(r.tokens ** 0.5 for r in rows)
    total = sum(r.tokens for r in rows)
    assert len(rows) == 1100
    assert all(abs(r.weight * r.tokens / total - r.tokens ** 0.5 / roots) < 1e-9 for r in rows)
    assert abs(sum(r.probability * r.tokens for r in rows) - total / 2) < 1e-6
    named = mixing.Settings(targets={"source": {"s0": 0.25, "s7": 0.75}}, keep_tokens=0.001)
    share = {r.row.source: r.probability * r.tokens for r in mixing.mix(frame(texts), settings=named).collect()}
    assert {s for s, x in share.items() if x > 0} == {"s0", "s7"}
    assert abs(3 * share["s0"] - share["s7"]) < 1e-9


def test_raking_on_tables_equals_raking_on_the_driver(frame, rows):
    texts = [(i, t * (1 + i % 4), (None, "en", "de")[i % 3], (None, "=x", "x", "y", "(null)")[i * i % 5], n)
             for i, t, _, _, n in rows]
    for given in ({}, {"source": {"x": 0.7, "y": 0.2}}):
        weights = []
        for limit in (1, 1000):
            settings = mixing.Settings(max_sources=limit, keep_tokens=0.8, targets=given, rounds=8)
            weights.append({r.row.doc_id: (r.weight, r.probability, r.selected) for r in
                            mixing.mix(frame(texts), settings=settings).collect()})
        assert weights[0].keys() == weights[1].keys() == {t[0] for t in texts}
        for i, (w, p, chosen) in weights[0].items():
            assert weights[1][i] == (pytest.approx(w, abs=1e-9), pytest.approx(p, abs=1e-9), chosen)


def test_odd_rows(spark, odd, nothing, frame):
    lexicon, weights = toxicity.train(odd, frame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert toxicity.score(odd, lexicon, weights).count() == odd.count()
    model = quality_classifier.train(odd, frame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r.score for r in quality_classifier.score(odd, model).collect()} == {0.5}
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and not any(r.selected for r in mixed if r.tokens == 0)
    pages = frame([(1, None, None), (1, "u", ""), (None, "u", "<p>" * 5000 + "x"), (2, "u", "<" * 9000)],
                  "page_id long, url string, html string")
    assert [r.n_chars for r in html_text.extract_pages(pages).orderBy("url").collect()][0] == 0
    for made in (toxicity.score(nothing, lexicon, weights), quality_classifier.score(nothing, model), mixing.mix(nothing),
                 html_text.extract_pages(pages.limit(0))):
        assert made.count() == 0


def test_html_nested_very_deep_is_read_in_one_pass():
    """Markup nested 20,000 deep; a cost that grows with the depth would take minutes."""
    line = "A sentence with enough words in it that it is taken for a part of the article."
    start = time.perf_counter()
    deep = "<article>" + "<div>" * 20_000 + f"<p>{line}</p>" + f"<p>{line}</p></div>" * 20_000 + "</article>"
    assert html_text.extract(deep) == "\n".join([line] * 20_001)
    assert time.perf_counter() - start < 30
