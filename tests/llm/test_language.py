"""The language model against scores worked out word by word."""

import math
import random
from collections import Counter

import pytest

from tessella.llm import language


def naive(counts, text, longest=language.LONGEST):
    """The sums by language, from the definition: a known word's log frequency, else the mean of its longest known n-grams."""
    langs = sorted({x for x, _, _ in counts})
    tables = [{x: Counter() for x in langs} for _ in range(longest + 1)]
    for lang, word, n in counts:
        tables[0][lang][word] += n
        for k in range(1, longest + 1):
            for i in range(len(word) + 3 - k):
                tables[k][lang][f" {word} "[i : i + k]] += math.sqrt(n)
    keys = [set().union(*t.values()) for t in tables]

    def log(k, key):
        return [math.log((t[key] + 0.1) / (sum(t.values()) + 0.1 * len(keys[k]))) for t in tables[k].values()]

    sums, n = [0.0] * len(langs), 0
    for word in text.split():
        rows = [log(0, word)] if word in keys[0] else []
        for k in range(min(longest, len(word) + 2), 0, -1):
            rows = rows or [log(k, g) for i in range(len(word) + 3 - k) if (g := f" {word} "[i : i + k]) in keys[k]]
        if rows:
            n += 1
            sums = [s + sum(c) / len(rows) for s, c in zip(sums, zip(*rows))]
    return langs, sums, n


def test_scores_are_those_of_the_definition():
    rng = random.Random(4)
    letters = {"de": "enrstichü", "en": "etaoinshr", "fr": "esaitnréu"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 8)))
    counts = [(x, w, n) for x in letters for w, n in Counter(word(x) for _ in range(300)).items()]
    assert min(n for *_, n in counts) == 1
    model = language.Model.fit(counts)
    assert set(model.words) == {w for _, w, _ in counts}  # words seen once are known too
    for _ in range(200):
        text = " ".join(word(rng.choice([*letters])) + rng.choice(["", "", "zq"]) for _ in range(rng.randrange(1, 12)))
        langs, sums, n = naive(counts, text)
        got, score = model.predict(text)
        best = max(sums)
        assert sums[langs.index(got)] == pytest.approx(best)
        assert score == pytest.approx(1 / sum(math.exp((s - best) / n * min(n, language.EVIDENCE)) for s in sums))


def test_ties_go_to_the_first_language():
    """Other words in another order, the same word as often, and as many words in all."""
    rng = random.Random(6)
    for _ in range(30):
        ns = [rng.randrange(1, 9) for _ in range(50)]
        counts = [("fr", f"a{i}", n) for i, n in enumerate(ns)] + [("en", f"b{i}", n) for i, n in enumerate(sorted(ns))]
        model = language.Model.fit([*counts, ("fr", "same", 3), ("en", "same", 3)])
        assert model.predict("same") == ("en", pytest.approx(0.5))
