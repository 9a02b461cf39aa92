"""Licence scans through a positional index of rare words, in DataFrame functions only.

A template is a licence notice with a mandatory key phrase. The index is a table of postings: a word, a
template, the word's place in it. Of each template it has the ``ANCHORS`` words of highest inverse document
frequency, and the rarest word of the key phrase in any case. A file's words that the index has are joined with
the postings; a place in the file less the place in the template is the offset at which the notice would begin,
and postings that agree on template and offset meet in one group. An offset is kept if the phrase's rarest word
stands there; then the whole phrase is verified in the file's words. The share of the notice's words that
stand where the template has them is the coverage; a verified phrase counts at any coverage. Every
place of a phrase contains its rarest word, so none is lost.

Document frequencies are counted over all rows, for the words of the templates only. What is broadcast,
the postings, is bounded by the templates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import NO_LETTER, Store, ascii_lower, if_small, same, text_key, texts

#: Rarest words of a notice that the index has.
ANCHORS = 6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def start(self) -> int:
        """Place of the phrase in the template."""
        size = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + size] == self.key)


# Labels, opening words of well-known notices as the scanner sees them, and the words that
# a file must have. Base phrases are templates of their own.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    Template("artistic", "distributed under the terms of the artistic license", "artistic license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source"),
    Template("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("busl", "use of this software is governed by the business source license", "business source license"),
    Template("cc", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "attribution noncommercial"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives license", "attribution noderivatives"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", "attribution sharealike"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "has waived all copyright"),
    Template("cc0", "cc0 1 0 universal", "cc0"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("ecl-2.0", "licensed under the educational community license version 2 0", "educational community license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("eupl", "licensed under the european union public licence", "european union public licence"),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu gpl", "gnu gpl"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("isc", "released under the isc license", "isc license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("lgpl", "under the terms of the gnu library general public license", "library general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("ms-pl", "distributed under the microsoft public license", "microsoft public license"),
    Template("ncsa", "university of illinois ncsa open source license", "ncsa open source license"),
    Template("odbl", "made available under the open database license", "open database license"),
    Template("ofl", "this font software is licensed under the sil open font license", "open font license"),
    Template("osl-3.0", "licensed under the open software license version 3 0", "open software license"),
    Template("postgresql", "released under the postgresql license", "postgresql license"),
    Template("proprietary", "this software is proprietary and confidential unauthorized copying of this file is strictly prohibited", "proprietary and confidential"),
    Template("psf", "licensed under the python software foundation license", "python software foundation license"),
    Template("public-domain", "this work has been released into the public domain by its author", "into the public domain"),
    Template("sspl", "under the terms of the server side public license", "server side public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("upl", "licensed under the universal permissive license", "universal permissive license"),
    Template("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    Template("zlib", "released under the zlib license", "zlib license"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NO_LETTER), "")


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frequencies(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Number of rows that have each word of a template (null text: none)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect(words(F.col("text")), _literal(vocabulary))
    counts = texts(docs).select(F.explode(present).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def postings(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The index: ``word``, ``template`` (its number), ``place``, and ``key`` for the rarest word of a phrase."""
    seen = frequencies(docs, templates)
    rows = []
    for number, t in enumerate(templates):
        rare = sorted(range(len(t.words)), key=lambda i: (seen[t.words[i]], t.words[i], i))
        phrase = min(range(t.start, t.start + len(t.key)), key=lambda i: (seen[t.words[i]], t.words[i], i))
        rows += [(t.words[i], number, i, i == phrase) for i in sorted({*rare[:ANCHORS], phrase})]
    return docs.sparkSession.createDataFrame(rows, "word string, template int, place int, key boolean")


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and ``found``: templates and offsets at which a phrase's rarest word stands.

    ``votes`` are the postings that agree on the offset. The words of one file meet its own postings only.
    """
    known = [r["word"] for r in index.select("word").distinct().collect()]  # bounded by the templates
    hit = F.transform(
        words(F.col("text")), lambda x, i: F.when(x.isin(known), F.struct(i.alias("at"), x.alias("word")))
    )
    hits = rows.select("doc_id", "key", F.explode(F.array_compact(hit)).alias("hit")).select("doc_id", "key", "hit.*")
    places = index.withColumnRenamed("key", "rarest")
    met = hits.join(F.broadcast(places), "word").withColumn("offset", F.col("at") - F.col("place"))
    voted = met.groupBy("doc_id", "key", "template", "offset").agg(
        F.count(F.lit(1)).alias("votes"), F.bool_or("rarest").alias("rarest")
    )
    kept = voted.where("rarest").groupBy("doc_id", "key")
    return kept.agg(F.sort_array(F.collect_list(F.struct("template", "offset", "votes"))).alias("found"))


def _of_each(templates: Sequence[Template], value) -> Column:
    return F.array(*[value(t) for t in templates])


def verified(w: Column, found: Column, templates: Sequence[Template]) -> Column:
    """The places at which the whole phrase stands: label, base, first word of the phrase, coverage."""
    start, label, base, notice, phrase = (
        _of_each(templates, f) for f in (
            lambda t: F.lit(t.start), lambda t: F.lit(t.label), lambda t: F.lit(t.base),
            lambda t: _literal(t.words), lambda t: _literal(t.key),
        )
    )

    def place(x: Column) -> Column:
        own, expected = x["template"], F.get(notice, x["template"])
        inside = F.filter(
            F.sequence(F.lit(0), F.size(expected) - 1), lambda i: F.get(w, x["offset"] + i) == F.get(expected, i)
        )
        key, at = F.get(phrase, own), x["offset"] + F.get(start, own)
        stands = (at >= 0) & (F.slice(w, F.greatest(at, F.lit(0)) + 1, F.size(key)) == key)
        return F.when(stands, F.struct(
            F.get(label, own).alias("label"), F.get(base, own).alias("base"), at.alias("at"),
            (F.size(inside) / F.size(expected)).alias("coverage"),
        ))

    return F.array_compact(F.transform(found, place))


def scan(docs: DataFrame, store: Store, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of every row: label, base, first word of the phrase, coverage.

    Null and empty texts have no words and no places. Overlapping places all count; equal
    rows give equal rows; other columns are left out.
    """
    rows = texts(docs).withColumn("key", text_key(F.col("text")))
    found = if_small(store.put(lookup(rows, postings(docs, templates)), "found"))
    nothing = F.array().cast(found.schema["found"].dataType)
    both = rows.join(found, same(rows, found, "doc_id", "key"), "left").select(
        rows["doc_id"], words(F.col("text")).alias("w"), F.array_distinct(F.coalesce("found", nothing)).alias("found")
    )
    places = verified(F.col("w"), F.col("found"), templates)
    return both.select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row the number and ends of base places, the labels and the best coverage."""
    base = F.filter("places", lambda x: x.base)
    at = F.transform(base, lambda x: x["at"].cast("long"))
    names = lambda places: F.array_join(
        F.array_sort(F.array_distinct(F.transform(places, lambda x: x.label))), ","
    )
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x.coverage)), F.lit(0.0)).alias("score"),
    )
