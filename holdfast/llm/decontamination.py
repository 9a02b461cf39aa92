"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``window`` words has ``window - k + 1`` k-word grams; the one of least hash is
its fingerprint. A document and an item that share such a run share its fingerprint, so the
join of fingerprints finds every shared run. Grams are 64-bit hashes: a hit is only a place
to look. From each hit the words are compared to the left and right until they differ, and
an extended match of at least a window marks its words.

An item of fewer words than a window is one window of its own length; its fingerprint is
the hash of all its words, and documents show the hashes of all their runs of that length.

Two joins: the first carries hashes only and names the documents with a hit; the second
carries the words around the fingerprints, for those documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import NO_LETTER, Store, ascii_lower, if_small, same, text_key, texts

WINDOW, GRAM = 10, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NO_LETTER), "")


def _run_hashes(w: Column, length: int) -> Column:
    """Hash of the ``length`` words from every place that has as many."""
    return F.when(
        F.size(w) >= length,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - length),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(h: Column, width: int) -> Column:
    """The least of every ``width`` neighbours."""
    return F.when(
        F.size(h) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - width),
            lambda i: F.least(*[F.get(h, i + j) for j in range(width)]) if width > 1 else F.get(h, i),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _selected(h: Column, m: Column, width: int) -> Column:
    """Places of ``h`` that are least in one of the windows around them, ties included."""
    return F.filter(
        F.sequence(F.lit(0), F.size(h) - 1),
        lambda p: F.get(h, p)
        == F.greatest(*[F.coalesce(_at(m, p - j), F.get(h, p) - F.lit(1)) for j in range(width)]),
    )


def _at(array: Column, i: Column) -> Column:
    """Null outside the array, also before its start."""
    return F.when(i >= 0, F.get(array, i))


def _short_lengths(items: DataFrame, window: int) -> list[int]:
    """Lengths below a window that items have: at most ``window - 1`` numbers."""
    found = items.where(F.size("w").between(1, window - 1)).select(F.size("w").alias("n")).distinct()
    return sorted(r.n for r in found.collect())


def _places(rows: DataFrame, keys: list[str], window: int, k: int, lengths: list[int]) -> DataFrame:
    """One row per fingerprint of ``w``: its length class ``n`` (0: windows), hash ``f``, place
    ``p``, and the words before (nearest first), in and after it that a window can reach."""
    reach = window - k
    w, h = F.col("w"), F.col("h")
    marked = rows.withColumn("h", _run_hashes(w, k)).withColumn("m", _minima(h, reach + 1))
    long = F.when(F.size("m") > 0, F.transform(
        _selected(h, F.col("m"), reach + 1),
        lambda p: F.struct(
            F.lit(0).alias("n"), F.get(h, p).alias("f"), p.alias("p"),
            F.reverse(F.slice(w, F.greatest(p - reach + 1, F.lit(1)), F.least(p, F.lit(reach)))).alias("before"),
            F.slice(w, p + 1, F.lit(k)).alias("gram"),
            F.slice(w, p + 1 + k, F.lit(reach)).alias("after"),
        ),
    ))
    out = marked.select(*keys, F.explode(long).alias("x")).select(*keys, "x.*")
    for n in lengths:
        short = F.transform(
            _run_hashes(w, n),
            lambda f, p, n=n: F.struct(
                F.lit(n).alias("n"), f.alias("f"), p.alias("p"),
                F.array().cast("array<string>").alias("before"),
                F.slice(w, p + 1, F.lit(n)).alias("gram"),
                F.array().cast("array<string>").alias("after"),
            ),
        )
        out = out.union(rows.select(*keys, F.explode(short).alias("x")).select(*keys, "x.*"))
    return out


def _hashes(rows: DataFrame, keys: list[str], window: int, k: int, lengths: list[int]) -> DataFrame:
    """Distinct fingerprints of every row, without places and words."""
    marked = rows.withColumn("h", _run_hashes(F.col("w"), k))
    out = marked.select(*keys, F.lit(0).alias("n"), F.explode(F.array_distinct(_minima(F.col("h"), window - k + 1))).alias("f"))
    for n in lengths:
        found = F.explode(F.array_distinct(_run_hashes(F.col("w"), n)))
        out = out.union(rows.select(*keys, F.lit(n).alias("n"), found.alias("f")))
    return out


def _agree(a: Column, b: Column) -> Column:
    """Number of leading words that two arrays have in common."""
    return F.aggregate(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct(
            F.when(s.on & (x.a == x.b), s.n + 1).otherwise(s.n).alias("n"),
            F.coalesce(s.on & (x.a == x.b), F.lit(False)).alias("on"),
        ),
        lambda s: s.n,
    )


def matches(docs: DataFrame, items: DataFrame, store: Store, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``doc_id``, ``key``, ``item_id``, ``first``, ``last``: words of a document (from 0) that also
    stand in an item, as extended matches. They overlap where windows do.

    Rows that are equal in ``doc_id`` and text count as one. Null texts and items have no words.
    An item with a null id matches like any other.
    """
    given = texts(docs).withColumn("key", text_key(F.col("text")))
    listed = store.put(
        items.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0), "items"
    )
    lengths = _short_lengths(listed, window)
    whole = listed.where(F.size("w") >= window)
    short = [
        _places(listed.where(F.size("w") == n), ["item_id"], window, k, [n]).where(F.col("n") == n) for n in lengths
    ]
    places = _places(whole, ["item_id"], window, k, [])
    for more in short:
        places = places.union(more)
    places = store.put(places, "places")
    prints = store.put(places.select("n", "f").distinct(), "prints")

    shown = _hashes(given.select("doc_id", "key", words(F.col("text")).alias("w")), ["doc_id", "key"], window, k, lengths)
    hit = shown.join(if_small(prints), ["n", "f"], "left_semi").select("doc_id", "key").distinct()
    hit = if_small(store.put(hit, "hit"))
    named = given.join(hit, same(given, hit, "doc_id", "key"), "left_semi")
    around = _places(
        named.select("doc_id", "key", words(F.col("text")).alias("w")).distinct(),
        ["doc_id", "key"], window, k, lengths,
    ).alias("d")
    both = around.join(
        if_small(places).alias("i"),
        (F.col("d.n") == F.col("i.n")) & (F.col("d.f") == F.col("i.f")) & (F.col("d.gram") == F.col("i.gram")),
    )
    left, right = _agree(F.col("d.before"), F.col("i.before")), _agree(F.col("d.after"), F.col("i.after"))
    size = F.size("d.gram")
    return (
        both.select("d.doc_id", "d.key", "i.item_id", "d.n", "d.p", left.alias("l"), (size + right).alias("r"))
        .where((F.col("n") > 0) | (F.col("l") + F.col("r") >= window))
        .select("doc_id", "key", "item_id", (F.col("p") - F.col("l")).alias("first"),
                (F.col("p") + F.col("r") - 1).alias("last"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, store: Store, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Per row ``doc_id``, ``key``, ``n_words``, ``n_hit`` and ``items`` (sorted texts of the item ids).

    ``n_hit`` counts the words inside any occurrence of a window. Equal rows get equal results;
    null and empty texts have no words; empty tables give no hits.
    """
    found = store.put(matches(docs, items, store, window, k).distinct(), "matches")
    spans = found.select("doc_id", "key", "first", "last").distinct()
    before = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reached = F.coalesce(
        F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)
    )
    fresh = F.greatest(F.col("last") - F.greatest(reached, F.col("first") - 1), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("doc_id", "key", F.col("item_id").cast("string").alias("item")).distinct()
    lists = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = hits.join(lists, same(hits, lists, "doc_id", "key")).select(hits.doc_id, hits.key, "n_hit", "items")
    result = if_small(store.put(result, "result"))
    rows = texts(docs).select(
        "doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    return rows.join(result, same(rows, result, "doc_id", "key"), "left").select(
        rows.doc_id, rows.key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
