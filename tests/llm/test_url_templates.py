"""URL verdicts against rules read one by one and a tree that is built host by host."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from holdfast.llm import url_templates
from holdfast.llm.common import Store
from holdfast.llm.queries import QUERIES, URL_RULES

TINY = "/root/testdata/sf0.001"


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "block"), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def tree_directly(rows):
    """(host, path, label) rows to {(host, path): (template, purity)}."""
    labels = Counter(label for *_, label in rows)
    smooth = lambda blocked, allowed, parent: (blocked + 10 * parent) / (allowed + blocked + 10)
    overall = smooth(labels["block"], labels["allow"], 0.5)
    out = {}

    def masked(segment):
        for char, code in (("%", "%25"), ("*", "%2A"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D")):
            segment = segment.replace(char, code)
        return re.sub("[0-9]+", "#", segment)

    def shares(members):
        n = len(members)
        kinds = Counter()
        for _, rest, label in members:
            after = rest[1] if len(rest) > 1 else None
            kinds["end" if after is None else "slash" if after == "" else "num" if re.search("[0-9]", after) else "word"] += 1
            kinds[label] += 1
        return n, [kinds[k] / n for k in ("allow", "block", "end", "slash", "num", "word")]

    def close(one, other):
        (n, a), (m, b) = shares(one), shares(other)
        bound = math.sqrt(0.5 * math.log(2 / 0.05)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return all(abs(x - y) < bound for x, y in zip(a, b))

    def descend(key, host, node, purity, members, depth):
        branches = defaultdict(list)
        for m in members:
            if not m[1]:
                out[host, m[0]] = (node, purity)
            else:
                branches[masked(m[1][0]) if depth < 12 else "**"].append((m[0], m[1] if depth < 12 else m[1][:1], m[2]))
        total = sum(map(len, branches.values()))
        named = defaultdict(list)
        for name, found in branches.items():
            named[name if len(found) * 32 >= total else "*"] += found
        groups = []
        for name, found in sorted(named.items(), key=lambda x: (-len(x[1]), x[0])):
            fit = next((g for g in groups if name != "*" and g[0] != ["*"] and close(found, g[1])), None)
            if fit:
                fit[0].append(name)
                fit[1].extend(found)
            else:
                groups.append(([name], list(found)))
        for names, found in groups:
            count = Counter(m[2] for m in found)
            name = "{" + "|".join(sorted(names)) + "}" if len(names) > 1 else names[0]
            below = [(p, rest[1:], label) for p, rest, label in found]
            descend(key, host, f"{node}/{name}", smooth(count["block"], count["allow"], purity), below, depth + 1)

    for host in {r[0] for r in rows}:
        own = [(path, path.split("/")[1:], label) for h, path, label in rows if h == host]
        count = Counter(m[2] for m in own)
        descend(host, host, "", smooth(count["block"], count["allow"], overall), own, 0)
    return out


def judged_directly(rows, rules, given=None):
    given = given or [None] * len(rows)
    split = [parsed(url) for _, url in rows]
    ruled = [rule_of(h, p, rules) for h, p in split]
    tree = tree_directly([(h, p, r[1] or g) for (h, p), r, g in zip(split, ruled, given)])
    out = []
    for (page, _), (h, p), (rule, verdict) in zip(rows, split, ruled):
        template, purity = tree[h, p]
        out.append((page, h, p, rule, verdict or ("block" if purity >= 0.8 else "allow"), template, round(purity, 9)))
    return sorted(out, key=str)


def found_rows(df):
    return sorted((tuple(r)[:6] + (round(r.purity, 9),) for r in df.collect()), key=str)


def test_equals_the_direct_tree_on_the_table(spark):
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.collect()]
    assert found_rows(QUERIES["op13_path_templates"](spark, TINY)) == judged_directly(rows, URL_RULES)


@pytest.mark.parametrize("seed", (1, 2))
def test_equals_the_direct_tree_on_odd_urls(spark, seed):
    random.seed(seed)
    words = ["en", "de", "shop", "tag", "a*b", "x{1}", "é", "", "page"]
    rows, given = [], []
    for i in range(900):
        host = random.choice(("a.com", "A.com", "b.org", "spam.net", "q.example.org", ""))
        depth = random.choice((0, 1, 2, 3, 3, 15))
        parts = [random.choice((*words, str(random.randrange(999)), f"{random.choice(words)}{random.randrange(9)}.html",
                                "".join(random.choices("abcdefghij", k=6)))) for _ in range(depth)]
        url = "http://" + host + "".join("/" + p for p in parts) + random.choice(("", "", "?q=1/2", "#://x"))
        rows.append((random.choice((i, None)), random.choice((url, url, url, url, None, "no scheme", "://"))))
        bad = url.startswith("http://spam.net/shop") or "tag" in parts[:1]
        given.append(random.choice((None, "block" if bad else "allow", "odd")))
    rows += rows[:40]
    given += given[:40]
    full = spark.createDataFrame([(*r, g) for r, g in zip(rows, given)], "page_id long, url string, teach string")
    for extra in ("host", "path", "node", "n", "rest", "html", "rule"):
        full = full.withColumn(extra, full["url"])
    found = url_templates.judge(full, URL_RULES, Store(spark), label="teach")
    labels = [g if g != "odd" else None for g in given]
    assert found_rows(found) == judged_directly(rows, URL_RULES, labels)
    assert url_templates.judge(full.limit(0), URL_RULES, Store(spark)).collect() == []


def test_labels_reach_unlabelled_pages_of_their_template(spark):
    rows = [(i, f"http://x.net/buy/{i}/now", "block" if i % 2 else None) for i in range(200)]
    rows += [(1000 + i, f"http://x.net/news/{i}", "allow" if i % 2 else None) for i in range(200)]
    found = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string, y string"), (), Store(spark), "y")
    verdicts = {(r.path.split("/")[1], r.verdict, r.template) for r in found.collect()}
    assert verdicts == {("buy", "block", "/buy/#/now"), ("news", "allow", "/news/#")}


def test_alike_branches_merge_and_unlike_ones_stay(spark):
    rows = [(i, f"http://x.net/{lang}/{i}") for i in range(300) for lang in ("de", "en")]
    rows += [(i, "http://x.net/feed/latest/") for i in range(300)]
    found = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), (), Store(spark))
    assert {r.template for r in found.collect()} == {"/{de|en}/#", "/feed/latest/"}
