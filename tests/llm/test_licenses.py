"""Licence places against a direct search of every phrase, and the index against its definition."""

from __future__ import annotations

import random
import re

from holdfast.llm import licenses
from holdfast.llm.common import Store

SCHEMA = "doc_id long, text string"


def directly(text, templates):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    out = []
    for t in templates:
        for at in range(len(w)):
            if w[at : at + len(t.key)] == t.key:
                begin = at - t.start
                inside = sum(0 <= begin + i < len(w) and w[begin + i] == x for i, x in enumerate(t.words))
                out.append((t.label, t.base, at, round(inside / len(t.words), 9)))
    return len(w), sorted(out)


def test_places_equal_the_direct_search(spark):
    random.seed(3)
    noise = ["the", "of", "license", "public", "general", "rights", "all", "é", "x1", "by", "cc"]
    rows = [(0, None), (1, ""), (2, "CC-BY cc by CC BY")]
    for i in range(3, 250):
        parts = random.choices(noise, k=random.randrange(30))
        for t in random.sample(licenses.TEMPLATES, random.randrange(4)):
            part = random.choice((t.words, t.key, t.words[: max(1, len(t.words) - 2)], t.words[1:]))
            spot = random.randrange(len(parts) + 1)
            parts[spot:spot] = part
        rows.append((i, random.choice((" ", "\n ", ", ")).join(p.upper() if random.random() < 0.2 else p for p in parts)))
    rows += rows[5:9]
    found = licenses.scan(spark.createDataFrame(rows, SCHEMA), Store(spark)).collect()
    ours = sorted(((r.doc_id, r.n_words, sorted((p.label, p.base, p["at"], round(p.coverage, 9)) for p in r.places)) for r in found), key=str)
    theirs = sorted(((i, *directly(text, licenses.TEMPLATES)) for i, text in rows), key=str)
    assert ours == theirs
    assert sum(len(x[2]) for x in ours) > 200


def test_many_labels_come_from_one_table():
    labels = {t.label for t in licenses.TEMPLATES}
    assert len(labels) >= 30 and {t.label for t in licenses.TEMPLATES if t.base} == {"cc-by", "gpl", "reserved"}
    for t in licenses.TEMPLATES:
        assert t.words[t.start : t.start + len(t.key)] == t.key


def test_the_index_has_the_rarest_words_and_every_phrase(spark):
    docs = spark.createDataFrame([(i, "general rights " * (i % 2) + "public all license by") for i in range(10)], SCHEMA)
    seen = licenses.frequencies(docs)
    assert seen["general"] == 5 and seen["public"] == 10 and seen["cc"] == 0
    index = licenses.postings(docs).collect()
    for number, t in enumerate(licenses.TEMPLATES):
        own = [r for r in index if r.template == number]
        assert all(t.words[r.place] == r.word for r in own)
        (rarest,) = [r for r in own if r.key]
        assert seen[rarest.word] == min(seen[x] for x in t.key) and t.start <= rarest.place < t.start + len(t.key)
        assert len(own) in (min(licenses.ANCHORS, len(t.words)), min(licenses.ANCHORS, len(t.words)) + 1)


def test_postings_vote_for_one_offset(spark):
    text = "x y " + " ".join(licenses.TEMPLATES[5].words) + " z"
    docs = spark.createDataFrame([(1, text)], SCHEMA).selectExpr("doc_id", "text", "1L AS key")
    index = licenses.postings(docs)
    (row,) = licenses.lookup(docs, index).collect()
    votes = {(f.template, f.offset): f.votes for f in row.found}
    assert votes[5, 2] == sum(r.template == 5 for r in index.collect())


def test_a_phrase_without_its_notice_counts_with_little_coverage(spark):
    docs = spark.createDataFrame([(1, "code under the Mozilla Public License")], SCHEMA)
    (row,) = licenses.summary(licenses.scan(docs, Store(spark))).collect()
    assert row.labels == "mpl" and 0 < row.score < 0.5 and row.n_base == 0 and row.first_word is None
