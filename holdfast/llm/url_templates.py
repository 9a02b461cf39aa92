"""URL filters: rules first, then a tree of path templates per host, judged by labelled purity.

A host's paths are descended level by level, all hosts at once. At a node, a path's next segment becomes

* a mask: digits are written ``#``, so ``825.html`` and ``12.html`` are one branch;
* or the wildcard ``*``, if less than one in ``RARE`` of the node's urls have that mask.

So a node has at most ``RARE`` branches besides the wildcard, whatever its urls. Sibling branches
whose urls look alike are merged into one, ``{de|en}``: Hoeffding's bound at ``ALPHA`` must allow
that the labels (allowed, blocked, none) and what follows (nothing, a closing slash, a number, a word)
come from equal shares. Segments beyond ``DEEPEST`` form one wildcard tail, ``**``.

Every node has a purity, the blocked share of its labelled urls, smoothed towards its parent's as if ``WEIGHT`` urls
of the parent's purity had been seen; a host's parent is the whole table. A template is rejected if its
purity is ``REJECT`` or more, so that paths without labels follow the nearest labelled ancestors.

Edge cases: a url that is null or has no ``://`` has empty host and path, and is judged like any
other. Rows that repeat are judged alike, each row is returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import LOWER, UPPER, Store, if_small

RARE = 32
ALPHA = 0.05
WEIGHT = 10.0
REJECT = 0.8
DEEPEST = 12


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://``; the path ends before ``?`` and ``#``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones the blocking one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text()), r.verdict == "block", r.text())):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text()).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def mask(segment: Column) -> Column:
    """A segment with digits as ``#``; the characters that templates use are escaped."""
    plain = segment
    for char, code in (("%", "%25"), ("*", "%2A"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D")):
        plain = F.replace(plain, F.lit(char), F.lit(code))
    return F.regexp_replace(plain, "[0-9]+", "#")


def follows(segment: Column) -> Column:
    """Kind of what follows a segment: 0 nothing, 1 a closing slash, 2 a number, 3 a word."""
    number = segment.rlike("[0-9]")
    return F.when(segment.isNull(), 0).when(segment == "", 1).when(number, 2).otherwise(3)


#: Counts of a branch: urls, allowed, blocked, and urls by what follows.
COUNTS = ("n", "allowed", "blocked", "ends", "slash", "number", "word")


def alike(one: Sequence[float], other: Sequence[float]) -> bool:
    """Whether Hoeffding's bound lets all shares of two branches (``COUNTS``) be equal."""
    bound = np.sqrt(0.5 * np.log(2 / ALPHA)) * (1 / np.sqrt(one[0]) + 1 / np.sqrt(other[0]))
    return all(abs(x / one[0] - y / other[0]) < bound for x, y in zip(one[1:], other[1:]))


def merged(branches: Sequence[tuple]) -> list[tuple[str, list[str], list[float]]]:
    """Groups of alike branches (name and ``COUNTS``): name, members, summed counts.

    Branches join by falling size, then by name, the first group that is alike. The wildcard stays alone.
    """
    groups: list[tuple[list[str], list[float]]] = []
    for name, *counts in sorted(branches, key=lambda b: (-b[1], b[0])):
        fit = None if name == "*" else next((g for g in groups if g[0] != ["*"] and alike(counts, g[1])), None)
        if fit is None:
            groups.append(([name], list(counts)))
        else:
            fit[0].append(name)
            fit[1][:] = [a + b for a, b in zip(fit[1], counts)]
    return [("{" + "|".join(sorted(m)) + "}" if len(m) > 1 else m[0], m, c) for m, c in groups]


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One node a row, with its bounded list of branches, to one row for each branch."""
    for frame in frames:
        out = []
        for host, node, purity, branches in frame.itertuples(index=False):
            given = [(b["mask"], *(float(b[c]) for c in COUNTS)) for b in branches]
            for name, members, counts in merged(given):
                allowed, blocked = counts[1], counts[2]
                smoothed = (blocked + WEIGHT * purity) / (allowed + blocked + WEIGHT)
                out += [(host, node, m, f"{node}/{name}", smoothed) for m in members]
        yield pd.DataFrame(out, columns=["host", "node", "mask", "next", "next_purity"])


def templates(paths: DataFrame, store: Store) -> DataFrame:
    """``host``, ``path``, ``template`` and ``purity`` of every path, stored.

    ``paths`` is stored and has distinct ``host`` and ``path`` with ``n``, ``allowed`` and ``blocked`` urls. Each level
    counts branches (map-side first), finds the frequent ones by a join, merges siblings of one
    node (bounded by ``RARE``) and moves the paths on; a host's paths never meet in one task.
    """
    seen = paths.measured
    allowed, blocked = float(seen["all_allowed"] or 0), float(seen["all_blocked"] or 0)
    overall = (blocked + WEIGHT * 0.5) / (allowed + blocked + WEIGHT)
    hosts = store.put(paths.groupBy("host").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")), "hosts")
    start = (F.col("b") + WEIGHT * overall) / (F.col("a") + F.col("b") + WEIGHT)
    segments = F.expr("slice(split(path, '/', -1), 2, 1 + length(path))")
    now = paths.join(if_small(hosts), "host").select(
        "host", "path", "n", "allowed", "blocked", F.lit("").alias("node"), start.alias("purity"), segments.alias("rest")
    )
    now = store.put(now, "level", left=F.count_if(F.size("rest") > 0))
    levels = [now]
    while levels[-1].measured["left"]:
        going = levels[-1].where(F.size("rest") > 0)
        levels.append(_descend(going, store, tail=len(levels) > DEEPEST))
    ended = [t.where(F.size("rest") == 0).select("host", "path", F.col("node").alias("template"), "purity") for t in levels]
    out = store.put(reduce(DataFrame.union, ended), "templates")
    store.drop(hosts, *levels)
    return out


def _descend(now: DataFrame, store: Store, tail: bool) -> DataFrame:
    """The paths one segment further, under the merged branches of their nodes."""
    head = F.lit("**") if tail else mask(F.get("rest", F.lit(0)))
    after = F.lit(None).cast("string") if tail else F.get("rest", F.lit(1))
    now = now.withColumns({"mask": head, "kind": follows(after)})
    kinds = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(COUNTS[3:])]
    branches = now.groupBy("host", "node", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS[:3]], *kinds, F.first("purity").alias("purity")
    )
    branches = store.put(branches, "branches")
    total = branches.groupBy("host", "node").agg(F.sum("n").alias("total"))
    listed = branches.join(total, ["host", "node"])
    name = F.when(F.col("n") * RARE >= F.col("total"), F.col("mask")).otherwise("*")
    listed = listed.withColumn("mask", name).groupBy("host", "node", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.first("purity").alias("purity")
    )
    nodes = listed.groupBy("host", "node").agg(
        F.first("purity").alias("purity"), F.collect_list(F.struct("mask", *COUNTS)).alias("branches")
    )
    kept = store.put(
        nodes.mapInPandas(_merge, "host string, node string, mask string, next string, next_purity double"), "merged"
    )
    small = if_small(kept)
    named = small.where("mask <> '*'")
    wild = small.where("mask = '*'").select(
        "host", "node", F.col("next").alias("wild"), F.col("next_purity").alias("wild_purity")
    )
    moved = now.join(named, ["host", "node", "mask"], "left").join(wild, ["host", "node"], "left")
    rest = F.array().cast("array<string>") if tail else F.expr("slice(rest, 2, size(rest))")
    moved = moved.select(
        "host", "path", "n", "allowed", "blocked", F.coalesce("next", "wild").alias("node"),
        F.coalesce("next_purity", "wild_purity").alias("purity"), rest.alias("rest"),
    )
    out = store.put(moved, "level", left=F.count_if(F.size("rest") > 0))
    store.drop(branches, kept)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], store: Store, label: str | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, purity``.

    ``rules`` become one expression, so they should be hundreds at most. ``label`` may name a column of pages with
    ``allow`` or ``block``; together with the rules' verdicts these labels teach the tree. A rule's
    verdict stands, other pages get their template's.
    """
    host, path = host_and_path(F.col("url"))
    given = F.lit(None).cast("string") if label is None else F.col(label)
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), given.alias("given"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    pages = store.put(pages.withColumns({"rule": rule, "ruled": verdict}), "pages")
    taught = F.coalesce("ruled", "given")
    counts = [F.count_if(F.coalesce(taught == v, F.lit(False))).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked"))]
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *counts)
    paths = store.put(paths, "paths", all_allowed=F.sum("allowed"), all_blocked=F.sum("blocked"))
    found = templates(paths, store)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return pages.join(if_small(found), ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity"
    )
