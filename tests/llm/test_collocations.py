"""Phrases against a direct count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from holdfast.llm import collocations
from holdfast.llm.common import Store

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def counted_directly(rows, min_count, limit):
    counts, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER_TO_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, of in counts.items():
        candidates = {p: a for p, a in of.items() if a >= min_count and len(p) > 1}
        longer = Counter()
        for p, a in candidates.items():
            inner = {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
            for q in inner:
                longer[q] = max(longer[q], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 100 * a:
                continue
            scores = [1000 * a * size[lang] // (of[p[:k]] * of[p[k:]]) for k in range(1, len(p))]
            k = scores.index(min(scores)) + 1
            found.append((-min(scores), -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def test_equals_direct_counts(spark):
    random.seed(5)
    vocabulary = ["The", "the", "of", "é", "\x1cx", "a b", "日本", "new", "york", "city"]
    rows = []
    for i in range(300):
        words = random.choices(vocabulary, weights=[9, 9, 8, 3, 1, 2, 2, 4, 4, 4], k=random.randrange(30))
        text = "".join(w + random.choice((" ", " ", " ", "  ", "\t", ". ", "\n")) for w in words)
        rows.append((random.choice(("en", "fr", None)), random.choice((text, text, text + " new york city", None))))
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", spark.range(1).selectExpr("'x'").scalar())
    for limit in (7, None):
        found = collocations.collocations(docs, Store(spark), min_count=6, limit=limit)
        assert sorted(tuple(r) for r in found.collect()) == counted_directly(rows, 6, limit)


def test_stripes_hold_frequent_entries_and_all_words(spark):
    rows = [("en", "a b c. a b d. a b c, x")] * 4 + [("en", "rare words")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    held = collocations.stripes(docs, Store(spark), min_count=4).collect()
    stripe = defaultdict(dict)
    for r in held:
        stripe[r.prefix][r.word] = r.n
    assert stripe == {"": {"a": 12, "b": 12, "c": 8, "d": 4, "x": 4, "": 2}, "a": {"b": 12}, "b": {"c": 8, "d": 4},
                      "a b": {"c": 8, "d": 4}}


def test_rare_words_that_share_a_bit_with_frequent_ones_count(spark):
    frequent, rare = [f"often{i}" for i in range(2000)], [f"once{i}" for i in range(300_000)]
    place = lambda words: collocations.Words("en", " ".join(words).encode()).hashes() >> np.uint64(
        64 - collocations.FILTER_BITS
    )
    shared = [rare[i] for i in np.flatnonzero(np.isin(place(rare), place(frequent)))]
    assert shared
    rows = [("en", " ".join(frequent))] * 3 + [("en", ". ".join(shared)), ("en", "x")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, Store(spark), min_count=3, limit=None)
    assert sorted(tuple(r) for r in found.collect()) == counted_directly(rows, 3, None)


def test_packed_numbers_and_sums():
    numbers = np.array([0, 1, 255, 256, 2**32 - 1], np.uint64)
    assert collocations._numbers(collocations._planes(numbers)).tolist() == numbers.tolist()
    keys, counts = collocations._summed(np.array([5, 2, 5, 9]), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [2, 5, 9] and counts.tolist() == [2, 4, 4]
    assert [x.tolist() for x in collocations._summed(np.zeros(0, int), np.zeros(0, int))] == [[], []]


@pytest.mark.parametrize("step", (64, 4096))
def test_long_texts_are_cut_between_pieces(monkeypatch, step):
    monkeypatch.setattr(collocations, "STEP_BYTES", step)
    import pandas as pd

    text = ("one two three. " * 400).encode()
    buffers = list(collocations._buffers(iter([pd.DataFrame({"lang": ["en", "en"], "text": [text, b""]})])))
    assert sum(len(b) for b in buffers) == 1200
    pairs = [there.sum() for b in buffers for n, _, there in collocations._levels(b, 2, None, 0) if n == 2]
    assert sum(pairs) == 800


def test_words_with_one_hash_are_told_apart():
    words = collocations.Words("en", b"ab cd ab ef cd")
    number, first = words.numbered(np.zeros(5, np.uint64))
    assert number.tolist() == [0, 1, 0, 2, 1] and [words.word(i) for i in first] == [b"ab", b"cd", b"ef"]
