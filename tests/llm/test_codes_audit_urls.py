"""Grid-cell codes, survival words and URL filters against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import gridcodes, interaction, urlfilter
from lamina.llm.queries import QUERIES

# Vector codes


def plain_nearest(parts, book):
    far = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize("spread, shift", [(3, 0), (40, 2), (40, 10), (600, 5), (1 << 27, 5)])
def test_cells_find_the_nearest_entry(spread, shift):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread + 1, (60, 5))
    book[7] = book[3]  # a tie in every cell
    parts = np.concatenate([rng.integers(-spread, spread + 1, (700, 5)), book, np.repeat(book[:2], 50, 0)])
    cells = gridcodes.Cells(book, shift, memo=200)
    for rows in (parts, parts[::-1]):
        code, error = cells.nearest(np.ascontiguousarray(rows))
        expected = plain_nearest(rows, book)
        assert (code == expected[0]).all() and (error == expected[1]).all()


def test_cells_are_remembered_and_entries_left_out():
    rng = np.random.default_rng(1)
    book, parts = rng.integers(-400, 400, (256, 4)), rng.integers(-400, 400, (500, 4))
    cells = gridcodes.Cells(book)
    cells.nearest(parts)
    assert cells.found == 0 and cells.compared < 500 * 256 / 8
    cells.nearest(parts)
    assert cells.found == len(np.unique(parts >> gridcodes.SHIFT, axis=0))


def plain_codes(rows):
    whole = [
        (i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * float(np.float32(x))))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    firsts = {}
    for i, v, _ in whole:
        if i is not None:
            firsts[i] = min(v, firsts.get(i, v))
    if not firsts:
        return Counter((i, None, None, None, hashlib.sha256(b"").hexdigest()) for i, _, _ in whole)
    width = min((i, len(v)) for i, v, _ in whole if i is not None)[1]
    books = [firsts[i] for i in sorted(i for i in firsts if len(firsts[i]) == width)][:256]
    cut = [p * width // 4 for p in range(5)]
    books = [[b[x:y] for b in books] for x, y in zip(cut, cut[1:])]
    fits = [r for r in whole if len(r[1]) == width]

    def nearest(v, p):
        part = v[cut[p] : cut[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        members = [defaultdict(list) for _ in range(4)]
        for _, v, _ in fits:
            for p in range(4):
                members[p][nearest(v, p)[1]].append(v[cut[p] : cut[p + 1]])
        for p in range(4):
            for k, parts in members[p].items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts)]
    done, sums = [], Counter()
    for i, v, label in whole:
        found = [nearest(v, p) for p in range(4)] if len(v) == width else None
        code = found and "".join(f"{k:02x}" for _, k in found)
        error = found and sum(far for far, _ in found)
        sums[label] += error or 0
        done.append((i, label, code, error))
    has = {label for _, label, _, e in done if e is not None}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[label] if label in has else None, digest) for i, label, c, e in done)


def codes_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = gridcodes.compress(df)
    return Counter(tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_awkward_vectors(spark, awkward_rows):
    assert codes_of(spark, awkward_rows["embeddings"]) == plain_codes(awkward_rows["embeddings"])
    nameless = [(None, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.0, 2.0, 3.0, 4.0], None)]
    assert codes_of(spark, nameless) == plain_codes(nameless)


def test_codes_of_clusters(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (9, 10))
    rows = [(int(i), [float(x) for x in middles[i % 9] + rng.normal(0, 0.1, 10)], int(i % 3)) for i in rng.permutation(700)]
    rows += [(1000 + i, rows[0][1], None) for i in range(300)]  # a third of all rows alike
    assert codes_of(spark, rows) == plain_codes(rows)


# Survival words


def test_bit_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 100, 4096, 10_001):
        words = rng.integers(0, 2**32, n, np.uint64).astype(np.uint32)
        plain = [int(((words >> np.uint32(i)) & 1).sum()) for i in range(32)]
        assert interaction.bit_counts(words).tolist() == plain


def plain_audit(documents, labels):
    texts = [(i, t or "", lang or "") for i, t, lang, *_ in documents]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, t, part in texts:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts):
            fails.add("E")
        failing.append((part, fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for _, _, p in texts}:
        own = [f for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                left = [f for f in own if not f[1] & before]
                removed = [f for f in left if x in f[1]]
                shapley[part, x] += len(removed)
                out[part, "".join(order), step] = (
                    len(left) - len(removed), len(removed), sum(x in f[1] for f in own) - len(removed),
                    sum(f[1] == {x} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_awkward_documents(spark, awkward, awkward_rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = QUERIES["op12_survival_words"](spark, awkward).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    assert found == plain_audit(awkward_rows["documents"], awkward_rows["labels"])


# URL filters

ADDRESSES = [
    None, "", "no address", "http://", "http:///x", "HTTP://Example.COM/en/x", "http://www.example.com/en/", "http://a.net/es/1",
    "https://a.net/es", "a://b://c.net/fr/", "http://xnet/es/1", "http://net/es/1", "http://www.EXAMPLE.com/EN/", "http://x.com",
    "http://x.com?q=/", "http://x.com/#a", "http://a.b.c.example.com/en/q?u=http://net/fr/", "http://user@h.net:80/fr/",
    "http://h.net:443/fr/", "http://casino.net/a/?b=2&a=1&utm_source=x#y", "http://www.casino.net:80/a?a=1&b=2&ref=z", "q://casino.net/a?a=1",
    "http://ÄÖ.net/fr/", "http://" + "l." * 3000 + "net/fr/", "http://casino.org/" + "p" * 100_000, "http://casino.org/\n", "//casino.net/a",
    "http://www.casino.net/a?b=2&a=1&", "http://m.Casino.net/a?a=1&b=2", "http://.net/fr/", "http://net./fr/", "http://ref.net/fr",
]


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]


def plain_rule(host, path, rules):
    fits = [
        (len(h + p), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits, default=(0, None, None))[1:]


def plain_verdicts(urls, rules, listed):
    for i, url in enumerate(urls):
        host, path = plain_address(url)
        rule, action = plain_rule(host, path, rules)
        yield i, host, path, rule, action or ("block" if url in listed else "allow")


def test_addresses_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(ADDRESSES)), "page_id long, url string").repartition(3)
    listed = {u for u in ADDRESSES if u and any(t in plain_address(u)[0] for t in urlfilter.TRADES)}
    found = {tuple(r) for r in urlfilter.judge_pages(pages).collect()}
    assert found == set(plain_verdicts(ADDRESSES, urlfilter.RULES, listed))


def test_one_canonical_form(spark):
    forms = ADDRESSES[19:21] + ADDRESSES[27:29]
    df = spark.createDataFrame([(u,) for u in forms], "url string")
    assert {r[0] for r in df.select(urlfilter.canonical(F.col("url"))).collect()} == {"casino.net/a?a=1&b=2"}


@pytest.mark.parametrize("blocks, few", [(1, 100_000), (1 << 18, 0)])
def test_neither_false_hits_nor_the_plan_change_a_verdict(spark, monkeypatch, blocks, few):
    """With one block for all keys most keys pass the filter; without a broadcast rules are merged."""
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(urlfilter, "RULES_EVERYWHERE", few)
    urls = [f"http://h{i % 97}.net/p{i}" for i in range(2000)] + [None] * 500 + ["http://h1.net/p1"] * 1500
    listed = {u for i, u in enumerate(urls) if u and i % 7 == 1}
    rules = [(f"h{i}.net", f"/p{j}", "allow" if j % 2 else "block") for i in range(20) for j in range(3)]
    rules += [(None, "/", "block"), ("", "/", "block"), ("h5.net", None, "block"), ("h6.net", "", "allow"), ("h6.net", "", "block")]
    given = spark.createDataFrame(rules, "host string, path string, action string")
    asked = spark.createDataFrame([(u[7:],) for u in listed] + [(None,)], "url string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    found = {tuple(r) for r in urlfilter.judge(pages, given, asked).collect()}
    plain = [(h, p or "", a) for h, p, a in rules if h and (h, p, a) != ("h6.net", "", "allow")]
    assert found == set(plain_verdicts(urls, plain, listed))


def test_the_filter_holds_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    blocks = urlfilter.blocks_for(20_000)
    filled = urlfilter.bloom(keys, blocks)
    assert urlfilter.may_hold(keys, filled, blocks).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert urlfilter.may_hold(others, filled, blocks).count() < 100
