"""Small document tables for the operators of the training-data package."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo wu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n)).capitalize() + "."


def corpus(seed, n=60):
    """Documents with exact and near copies, shared passages, repeated lines and junk."""
    rng = random.Random(seed)
    shared = [sentence(rng, 18) for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.4:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = word(rng)
            text = " ".join(words)
        else:
            lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
            if kind > 0.7:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
            text = "\n".join(lines)
        texts.append(text)
    ids = rng.sample(range(-50, 500), n)
    return [(i, t, "en", "s1" if rng.random() < 0.4 else "s2", len(t)) for i, t in zip(ids, texts)]


#: NULLs in any column, empty, blank and very long texts, repeated rows, repeated ids
ODD = [
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen", None, None, None),
    (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", 3), (4, "same row here", "en", "a", 13), (4, "same row here", "en", "a", 13),
    (5, "an id twice " * 8, "en", "a", 1), (5, "another text under it " * 8, "en", "a", 1),
    (6, "\n".join(f"line {i} of a very long text with {i * i} words" for i in range(3000)), "en", "b", 1),
    (7, "\x00 � \U0001f600 \x85   odd\x0bcharacters", "xx", "b", 1),
    (8, "\n\n\n", "en", "b", 3),
]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session", params=[1, 2])
def rows(request):
    return corpus(request.param)


CLASHING = ("row", "t", "w", "words", "lines", "key", "block", "component", "removed", "tokens",
            "weight", "kept", "text_a", "id", "parts", "topic", "clean_text")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use inside."""
    data = [(*r, *("x" for _ in CLASHING)) for r in ODD]
    return spark.createDataFrame(data, SCHEMA + "".join(f", {c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
