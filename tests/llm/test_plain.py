"""Whole verdicts, placements and matches against plain versions: URL trust, sharding, the lexicon, repeated lines."""

import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelloom.llm import lines, sharding, toxicity, urls
from panelloom.llm.queries import URL_RULES
from tests.llm import brute


def linked_pages():
    """A chain of 25 hosts behind a blocked one, a ring of trusted ones, both meeting, subdomains, and pages nobody reaches."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [("http://bad.com/de/1", link("far0.net")), ("http://good.org/a", link("t1.net", "t2.net")), ("http://t1.net/", link("t2.net")),
             ("http://t2.net/", link("good.org", "mixed.net", "www.shop.co.uk")), ("http://spam.net/p", link("bad.com", "mixed.net")),
             ("http://spam2.net/p", link("spam.net", "spam.net")), ("http://mixed.net/", link("bad.com")), ("http://alone.net/", None),
             ("http://other.co.uk/", ""), ("http://cdn.shop.co.uk/", ""), ("http://shop.co.uk/", ""), ("https://a.b.spam.net/q", ""),
             ("http://bad.com/en/", link("spam.net")), (None, link("bad.com")), ("none", link("good.org"))]
    for k in range(25):
        pages.append((f"http://c{k}.net/", link(f"c{k + 1}.net") if k < 24 else link("bad.com")))
    return [*pages, pages[4]]


def plain_ranks(edges, seeds, damping=0.85):
    names = sorted({x for e in edges for x in e} | set(seeds))
    move, seed = np.zeros((len(names), len(names))), np.zeros(len(names))
    for (s, d), w in edges.items():
        move[names.index(d), names.index(s)] = w
    for host, w in seeds.items():
        seed[names.index(host)] = w
    total = move.sum(0)
    for j in np.flatnonzero(total == 0):
        move[:, j] = seed  # weight at a host without edges returns to the seeds
    move, seed = move / move.sum(0), seed / seed.sum()
    rank = np.linalg.solve(np.eye(len(names)) - damping * move, (1 - damping) * seed)
    return dict(zip(names, rank))


def test_every_verdict_on_linked_pages(spark):
    rows = [(i, u, h, i, "f", "s") for i, (u, h) in enumerate(linked_pages())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, walk long, found string, src string")
    out = urls.judge(df, URL_RULES)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.columns[:6] == df.columns and len(got) == len(rows) and all(r["found"] == "f" and r["walk"] == i for i, r in got.items())

    host = lambda u: u.split("://")[1].split("/")[0] if u and "://" in u else ""
    edges, seeds, hosts = Counter(), defaultdict(Counter), set()
    for i, u, h, *_ in rows:
        hosts.add(host(u))
        for piece in (h or "").split('"')[1::2]:
            hosts.add(host(piece))
            if host(u) and host(u) != host(piece):
                edges[host(u), host(piece)] += 1
        if got[i]["rule"]:
            seeds[got[i]["verdict"]][host(u)] += 1
    for low, high in (("www.shop.co.uk", "shop.co.uk"), ("cdn.shop.co.uk", "shop.co.uk"), ("a.b.spam.net", "b.spam.net"), ("b.spam.net", "spam.net")):
        edges[low, high] += 1
        edges[high, low] += 1
    trust = plain_ranks(edges, seeds["allow"])
    distrust = plain_ranks(Counter({(d, s): w for (s, d), w in edges.items()}), seeds["block"])
    said = Counter()
    for i, u, *_ in rows:
        a, b = trust.get(host(u), 0.0), distrust.get(host(u), 0.0)
        assert abs(got[i]["trust"] - a) < 1e-5 and abs(got[i]["distrust"] - b) < 1e-5
        if not got[i]["rule"]:
            want = "block" if a + b > 0 and b / (a + b) > 0.5 else "allow"
            assert got[i]["verdict"] == want, host(u)
            said[want, host(u)] += 1
    # The first host of the chain is 25 links away from the blocked one; pages that nothing reaches are allowed.
    assert ("block", "c0.net") in said and ("block", "a.b.spam.net") in said and ("allow", "t1.net") in said and ("allow", "alone.net") in said


def test_domains_stop_where_names_are_registered(spark):
    df = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("com",), ("x.shop.co.uk",), ("co.uk",), ("a.de",), ("",)], "h string")
    got = [r[0] for r in df.select(urls.domain_chain(F.col("h"))).collect()]
    assert got == [["a.b.example.com", "b.example.com", "example.com"], ["example.com"], [], ["x.shop.co.uk", "shop.co.uk"], ["co.uk"], ["a.de"], []]


def plain_shard(key, tree):
    """Descend by the largest uniform draw's exponential, with the same 64-bit hash."""

    def draw(node, weight):
        h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        for x in node:
            h = xxhash.xxh64(struct.pack("<i", x), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    leaves = [x for x in tree if x.weight > 0]
    for depth in (2, 3, 4):
        node = lambda x: (x.grant, x.region, x.rack, x.shard)[:depth]  # noqa: E731, B023
        weight = Counter()
        for x in leaves:
            weight[node(x)] += x.weight
        won = next(iter(weight)) if len(weight) == 1 else min(weight, key=lambda n: draw(n, weight[n]))
        leaves = [x for x in leaves if node(x) == won]
    return leaves[0].shard


def test_descent_equals_a_plain_one(spark):
    tree = [*sharding.even_tree(17), sharding.Leaf(1, 0, 5, 2.5, 40), sharding.Leaf(2, 1, 10, 0.0, 41)]
    got = spark.range(-500, 1500).select("id", sharding.shard_of(F.col("id"), tree).alias("shard")).collect()
    assert [r["shard"] for r in got] == [plain_shard(r["id"], tree) for r in got]


def test_copies_are_cut_into_parts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    tree = sharding.even_tree(16)
    out = sharding.assign(df, tree, sharding.even_tree(17), chunk_rows=8)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    assert sum(map(len, slots.values())) == 1000
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    hot = max(slots.values(), key=len)
    assert sum(d == 7 for _, d in hot) == 700


def plain_matches(lexicon, folded):
    """Word by word: the heaviest term that begins it, unless it stands inside an excusing phrase."""
    words = folded.split()
    excused = set()
    for phrase in lexicon.exceptions:
        own = phrase.split()
        for k in range(len(words) - len(own) + 1):
            if words[k:k + len(own)] == own:
                excused.update(range(k, k + len(own)))
    found = []
    for k, word in enumerate(words):
        fits = [w for term, w in lexicon.terms.items() if word.startswith(term)]
        if fits and k not in excused:
            found.append(max(fits))
    return found


def test_matches_equal_a_plain_search():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    for _ in range(60):
        terms = {word(): round(rng.uniform(0.5, 4), 3) for _ in range(12)}
        text = [word() for _ in range(400)]
        pairs = {f"{text[k]} {text[k + 1]}" for k in rng.sample(range(399), 30)}
        lexicon = toxicity.Lexicon(terms, frozenset(pairs))
        folded = toxicity.fold(" ".join(text))
        assert [m[2] for m in toxicity.matches(lexicon, folded)] == plain_matches(lexicon, folded)


def test_learned_terms_have_no_count_and_neighbours_no_length(spark):
    """Thousands of telling words all become terms, and a neighbour of 500 letters excuses whole or not at all."""
    rng = random.Random(8)
    bad = ["".join(rng.choice("bcdfghjklm") for _ in range(9)) for _ in range(1500)]
    plain = [f"plain{k}" for k in range(50)]
    long = "y" * 500
    rows = [(i, " ".join([*rng.sample(plain, 5), *bad[(i % 30) * 50:(i % 30) * 50 + 50]]), 1) for i in range(300)]
    rows += [(i, " ".join([*rng.sample(plain, 8), f"{long} {bad[0]}" if i % 4 == 0 else ""]), 0) for i in range(300, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    unmatched = [w for w in bad[1:] if not any(w.startswith(t) for t in lexicon.terms)]
    assert not unmatched and len(lexicon.terms) > 1000
    assert all(len(p.split()) == 2 and (long in p.split() or len(p) < 30) for p in lexicon.exceptions)


@pytest.mark.parametrize("copies", [1, 3])
def test_lines_repeated_without_bound_in_one_document(spark, copies):
    """Many lost lines among many own ones: a hot line, a text of 60,000 lines, rows that share an id, and repeated rows."""
    shared = [f"a line that stands in several documents {k}" for k in range(300)]
    big = "\n".join(shared[k % 300] if k % 2 else f"own line {k}" for k in range(60_000))
    rows = [(1, big), (2, "\n".join(shared)), (3, "\n".join(reversed(shared))), (3, "x\n" + shared[0]), (None, shared[1]), (4, "\n".join([shared[0]] * 5000))] * copies
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(lines.joined(), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.cut_lines(rows), key=repr)
