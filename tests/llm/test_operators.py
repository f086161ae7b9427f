"""The operators against plain versions, with nulls, repeats, ties, long texts and clashing columns."""

import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelloom.llm import common, decontaminate, lines, paragraphs, pieces, quality, sharding, sigtree, substrings, toxicity, urls
from panelloom.llm.queries import PIECE_MODEL, URL_RULES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, bucket int, t1 string, score string, node long"


def given_rows():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    base = [word() for _ in range(300)]
    passage = " ".join(word() for _ in range(70))
    texts = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join([*base[:150], "changed", *base[151:]]), 4: " ".join(base[:280]),
        5: f"{' '.join(word() for _ in range(60))} {passage} {' '.join(word() for _ in range(30))}",
        6: f"{' '.join(word() for _ in range(25))}, {passage}\n{' '.join(word() for _ in range(40))}",
        7: None, 8: "", 9: " \n\t ", 10: "one two three", 11: "One TWO three", 12: "x" * 400_000, 13: "x" * 400_000 + "y",
        14: "spam " * 3000, 15: "spam " * 3100, 16: "Ünïcode Größe ΑΒΓ 日本語 " * 20, 17: "ünïcode größe αβγ 日本語 " * 20,
        18: "a common line of this corpus\nmine\n  A Common line of this corpus", 19: "A COMMON LINE OF THIS CORPUS  \nother",
        20: "first\na common line of this corpus", 21: "a common line of this corpus", 22: "\n\n\n", 23: "tab\tseparated\vwords\fand\rmore\x1cnot",
        24: " ".join(base[:260] + [word() for _ in range(40)]),
    }
    rows = [(i, t, "en", "s", len(t or ""), 99, "k", 1, "t", "s", 5) for i, t in texts.items()]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(given_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """As above, with a null id, a row repeated and an id used twice."""
    rows = given_rows()
    more = [(None, *rows[0][1:]), rows[0], rows[4], (3, *rows[5][1:]), (None, None, *rows[0][2:]), (100, "A common line of this corpus\nlast", *rows[0][2:])]
    return spark.createDataFrame([*rows, *more], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_substrings(frame, request, monkeypatch):
    monkeypatch.setattr(substrings, "RUN_ENTRIES", 500)
    df = request.getfixturevalue(frame)
    got = substrings.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sort(got) == sort(brute.cut_substrings(pairs(df)))


def test_substrings_of_ids_with_equal_row_hashes(docs, monkeypatch):
    given = substrings.texts_of
    monkeypatch.setattr(substrings, "texts_of", lambda *a: given(*a).withColumn("row", F.lit(7).cast("long")))
    got = substrings.dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sort(got) == sort(brute.cut_substrings(pairs(docs)))


def test_substrings_of_one_id_with_equal_short_hashes(spark):
    """Two texts of one id that 32 bits don't tell apart keep their own ranges."""
    passage = "a passage of more than fifty bytes that the first document holds"
    number = F.format_string("%08d", "id")
    hashed = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.concat(number, F.lit(passage))).otherwise(
        F.concat(F.lit(passage), number)).alias("text")).withColumn("h", F.hash(F.lit(1).cast("long"), "text"))
    head = F.col("text").startswith(passage)
    both = hashed.groupBy("h").agg(F.min(F.when(head, F.col("text"))), F.min(F.when(~head, F.col("text")))).dropna().first()
    rows = spark.createDataFrame([(0, passage), (1, both[1]), (1, both[2])], "doc_id long, text string")
    got = substrings.dedup_substrings(rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sort(got) == sort(brute.cut_substrings(pairs(rows)))


def test_anchor_choice_depends_on_the_window_alone():
    import numpy as np

    rng = np.random.default_rng(3)
    shared = rng.integers(97, 100, 200).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 100, 90).astype(np.uint8), shared])
    b = np.concatenate([rng.integers(97, 100, 37).astype(np.uint8), shared, rng.integers(97, 100, 60).astype(np.uint8)])
    one, other = (substrings.entries(x, np.array([0, len(x)]), np.array([1]), np.array([1])) for x in (a, b))
    inner = {int(k) for k, at, more in zip(one["reach"], one["at"], one["more"]) if at > 90 and at + more + 50 < 290}
    assert inner and inner - set(map(int, one["reach"])) == set()
    assert len(inner & set(map(int, other["reach"]))) >= len(inner) - 2


def test_near_duplicates(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sigtree.near_duplicates(docs).collect()}
    assert got == brute.linked(pairs(docs))


def test_near_duplicates_odd_rows(odd, none):
    rows = sigtree.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    by_id = {}
    for r in rows:
        if r["doc_id"] is not None:
            by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in by_id.values())
    # Id 3 also stands for a copy of document 6, so 6 joins the group of 1.
    assert by_id[6] == by_id[3] == by_id[1] == {1}
    assert sigtree.near_duplicates(none).collect() == []


def test_large_group_of_near_copies(spark, monkeypatch):
    """Parts of a cut cluster meet pair by pair and give one component."""
    monkeypatch.setattr(sigtree, "PART_MEMBERS", 16)
    monkeypatch.setattr(sigtree, "PART_SHINGLES", 2000)
    random.seed(2)
    base = [f"w{random.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        words[random.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sigtree.near_duplicates(df).collect()}
    assert got == brute.linked(rows)


def test_forest_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        own = rng.integers(0, 1 << 62, rng.integers(5, 120)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            changed = own.copy()
            k = rng.integers(0, len(own) // 4 + 1)
            changed[:k] = rng.integers(0, 1 << 62, k)
            sets.append(np.unique(changed))
    n = np.array([len(s) for s in sets])
    bits = np.stack([sigtree.bitmap(s) for s in sets])
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            met = len(np.intersect1d(sets[a], sets[b]))
            if 100 * met >= 80 * (n[a] + n[b] - met):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    found = list(range(len(sets)))
    for x, y in sigtree.forest(n, bits, sets):
        p, q = found[x], found[y]
        assert p != q
        found = [min(p, q) if g in (p, q) else g for g in found]
    same = lambda g: {tuple(i for i, v in enumerate(g) if v == k) for k in set(g)}
    assert same(found) == same(group)


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_decontamination(frame, request, spark):
    df = request.getfixturevalue(frame)
    texts = dict(pairs(df))
    items = [(1, " ".join(brute.PLAIN.findall(texts.get(1) or "nothing here")[40:70])), (2, "One, two; THREE"), (3, None), (4, ""),
             (5, "größe αβγ 日本語"), (6, "a b c d e f g h i j k l m n o"), (2, "one two three"), (7, "spam " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["id"], r["n_words"], r["n_hit"], len(r["item_ids"]), brute.sha(",".join(sorted(map(str, r["item_ids"])))), r["contaminated"])
           for r in decontaminate.contamination(df, bench).collect()]
    assert sort(got) == sort(brute.contamination(pairs(df), items))


def test_decontamination_without_broadcast(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TERMS", 0)
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 0)
    items = [(1, "one two three"), (2, "größe αβγ 日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["id"], r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()]
    assert sort(got) == sort(r[:3] for r in brute.contamination(pairs(docs), items))
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red green blue grey pink"), (2, "pink x grey blue y green red"), (3, "red a a a a a a a a a a pink")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "red green blue grey pink")], "item_id long, text string")
    index = decontaminate.build_index(df, bench)
    assert {r["id"] for r in decontaminate.phrase_matches(index).collect()} == {1}
    assert {r["id"] for r in decontaminate.proximity_matches(index).collect()} == {1, 2}


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_lines(frame, request):
    from pyspark.sql import functions as F

    df = request.getfixturevalue(frame)
    got = lines.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(lines.joined(), 256)).collect()
    assert sort(got) == sort(brute.cut_lines(pairs(df)))
    assert lines.dedup_lines(df).columns[:len(df.columns)] == df.columns


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_quality_measures(frame, request):
    df = request.getfixturevalue(frame)
    out = quality.judge(df, None)
    got = sort((r["doc_id"], *[r[m] for m in quality.MEASURES], r["base_failed"], r["kept"]) for r in out.collect())
    want = []
    for i, text in pairs(df):
        m = brute.measures(text)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want.append((i, *m, failed, not failed))
    assert got == sort(want)


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    held = quality.judge(docs, model).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.95
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.fit(docs.limit(0), labels) is None


def test_toxicity(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    lexicon = toxicity.learn(docs, labels, allowed=~held)
    out = toxicity.score(docs.where(held).join(labels, "doc_id"), lexicon).toPandas()
    rank = out["score"].rank()
    hits = out["toxic"].sum()
    auc = (rank[out["toxic"] == 1].sum() - hits * (hits + 1) / 2) / (hits * (len(out) - hits))
    assert auc > 0.93
    said = out["score"] >= 0.3
    assert (said == (out["toxic"] == 1)).mean() > 0.97


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t!") == " idiot " and toxicity.fold("IDIÓT") == " idiot " and toxicity.fold("іdіоt") == " idiot "
    assert toxicity.fold("trash$$$ x") == " trash x " and toxicity.fold("in 2024 and 1,000") == " in 2024 and 1 000 "
    assert toxicity.fold("") == "  " or toxicity.fold("").strip() == ""
    lexicon = toxicity.Lexicon({"idiot": 3.0, "idio": 1.0}, frozenset({"idiot savant"}))
    assert [m[2] for m in toxicity.matches(lexicon, toxicity.fold("An idiot, an Idiot savant, an idiom"))] == [3.0, 1.0]
    assert toxicity.measure(toxicity.Lexicon({}), " a b ") == (0, 0, 2)


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_toxicity_rows(frame, request):
    df = request.getfixturevalue(frame)
    out = toxicity.score(df, toxicity.Lexicon({"spam": 2.0}))
    assert out.count() == df.count() and set(df.columns) - {"score"} <= set(out.columns)
    assert all(0 <= r["score"] <= 1 for r in out.select("score").collect())


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_encoding_equals_the_library(frame, request):
    df = request.getfixturevalue(frame)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = pieces.encode(df, PIECE_MODEL, keep=("doc_id", "text")).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["ids"] == sp.encode(r["text"] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"])
    back = pieces.decode(pieces.encode(df, PIECE_MODEL), PIECE_MODEL)
    assert sort(pairs(back)) == sort((i, t or "") for i, t in pairs(df))


def test_encoding_of_odd_characters():
    vocab = pieces.vocabulary(open(PIECE_MODEL, "rb").read())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    random.seed(11)
    alphabet = "abcdefghijklm  ...\n\t ,;'\"()<>0123éüñ日本語😀Ωд▁ABC\x00"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 120))) for _ in range(400)]
    ids, at = pieces.encode_texts(vocab, texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == sp.encode(texts)


def test_urls(spark):
    rows = [(1, "http://A.example.ORG/es/1", None), (2, "https://example.org/en/12", ""), (3, "x.com/fr/", "a"), (4, None, None), (5, "http://b.com/fr/x?y#z", ""),
            (6, "http://b.com/en/x", '<a href="http://c.net/">'), (7, "http://notexample.org/es/", ""), (8, "ftp://c.net", ""), (9, "http://d.com/de/", ""),
            (10, "http://x://y/z", ""), (1, "http://A.example.ORG/es/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "1 AS weight")
    out = urls.judge(df, URL_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("b.com", "/fr/x", "com/fr/", "allow")
    assert got[7][2:] == ("org/", "allow") and got[8] == ("c.net", "", None, "allow") and got[9][2:] == ("com/de/", "block")
    assert got[10][:2] == ("x:", "//y/z")
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_rank_equals_power_iteration(spark):
    import numpy as np

    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0), ("d", "a", 1.0)]
    got = {r["host"]: r["rank"] for r in urls.personalised_rank(
        spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0), ("d", 3.0)], "host string, weight double"), rounds=5).collect()}
    names = "abcd"
    move = np.zeros((4, 4))
    for s, d, w in edges:
        move[names.index(d), names.index(s)] = w
    move /= np.maximum(move.sum(0), 1e-12)
    seed = np.array([0.25, 0, 0, 0.75])
    rank = seed
    for _ in range(5):
        rank = 0.15 * seed + 0.85 * move @ rank
    assert all(abs(got.get(n, 0) - r) < 1e-12 for n, r in zip(names, rank))


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_sharding(frame, request):
    df = request.getfixturevalue(frame)
    tree = sharding.even_tree(16)
    rows = sharding.assign(df, tree, sharding.grow(tree, sharding.Leaf(4, 0, 16)), chunk_rows=4).collect()
    want = sort((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(df))
    assert sort((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = {}
    for r in rows:
        assert placed.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20000).withColumnRenamed("id", "k")
    from pyspark.sql import functions as F

    tree = sharding.even_tree(16)
    more = sharding.grow(tree, sharding.Leaf(1, 0, 5, 2.0))
    got = ids.select(sharding.shard_of(F.col("k"), tree).alias("old"), sharding.shard_of(F.col("k"), more).alias("new"), "k").toPandas()
    moved = got[got["old"] != got["new"]]
    assert set(moved["new"]) == {5}
    share = got["new"].value_counts(normalize=True)
    assert abs(share[5] - 3 / 18) < 0.02 and abs(share[0] - 1 / 18) < 0.01
    # The 17th and 18th shard each take rows only into themselves.
    for n in (16, 17, 19, 20):
        both = ids.select(sharding.shard_of(F.col("k"), sharding.even_tree(n)).alias("old"), sharding.shard_of(F.col("k"), sharding.even_tree(n + 1)).alias("new")).toPandas()
        assert set(both[both["old"] != both["new"]]["new"]) == {n}


def passages_of(docs, length=51):
    """Ids of documents that hold a run of `length` words which a document of smaller id holds too."""
    seen, out = {}, set()
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = brute.SPACED.findall((text or "").translate(brute.LOW))
        for k in range(len(words) - length + 1):
            w = tuple(words[k:k + length])
            if seen.setdefault(w, i) < i:
                out.add(i)
    return out


@pytest.mark.parametrize("frame", ["docs", "odd", "none"])
def test_paragraphs(frame, request):
    df = request.getfixturevalue(frame)
    rows = paragraphs.dedup_paragraphs(df).collect()
    found = {r["doc_id"] for r in rows}
    assert passages_of(pairs(df)) <= found
    assert found <= {1, 2, 3, 4, 6, 13, 15, 17, 24, 5, 14}
    texts = {}
    for i, t in pairs(df):
        texts.setdefault(i, []).append(brute.SPACED.findall((t or "").translate(brute.LOW)))
    for r in rows:
        if r["kind"] == "passage" and len(texts[r["doc_id"]]) == 1:
            own = texts[r["doc_id"]][0][r["first_word"]:r["first_word"] + r["n_words"]]
            pieces_of = lambda w: {tuple(w[k:k + paragraphs.PIECE]) for k in range(len(w) - paragraphs.PIECE + 1)}
            assert any(pieces_of(own) & pieces_of(w) for w in texts[r["kept_doc_id"]])


def test_paragraph_groups_on_the_tables(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = paragraphs.repeated_paragraphs(df).collect()
    units = []
    for i, text in pairs(df):
        at = 0
        for line in text.split("\n"):
            words = brute.SPACED.findall(line)
            if len(words) >= paragraphs.LEAST_WORDS:
                units.append(((i, at), brute.shingle_set(line)))
            at += len(words)
    parent = list(range(len(units)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(units)):
        for b in range(a):
            x, y = units[a][1], units[b][1]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                met = len(x & y)
                if met >= 0.8 * (len(x) + len(y) - met):
                    p, q = find(a), find(b)
                    parent[p] = q
    groups = {}
    for k, (unit, _) in enumerate(units):
        groups.setdefault(find(k), []).append(unit)
    want = {u for g in groups.values() for u in g if u != min(g)}
    assert {(r["doc_id"], r["first_word"]) for r in rows} == want


def test_paragraphs_alike_in_a_key_of_unlike_members(spark, monkeypatch):
    """Links hold between members of a key that are neither its first nor next to each other."""
    import numpy as np

    from panelloom.llm import spans

    # One key of one value, and a phrase whose shingle is the lowest of every paragraph that holds it: all share the key.
    monkeypatch.setattr(paragraphs, "tune_bands", lambda *a: (1, 1))
    monkeypatch.setattr(paragraphs, "PART_MEMBERS", 16, raising=False)
    random.seed(3)
    words = [f"c{i}" for i in range(200_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    at = np.array([0, len(data)])
    starts, ends, row = spans.words(data, at)
    value, _ = spans.shingles(spans.Prefix(data).of(starts, ends), row, 5)
    factor = spans.mix(np.arange(1, 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    lowest = int(np.argmin(value * factor))
    phrase = words[lowest:lowest + 5]
    base = [[f"w{random.randint(0, 10**9)}" for _ in range(60)] for _ in range(30)]
    texts = [" ".join([*phrase, *b]) for b in base] + [" ".join([*phrase, *b[:-2], "other", "end"]) for b in base]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["kept_doc_id"]) for r in paragraphs.repeated_paragraphs(rows).collect()}
    assert got == {(i + 30, i) for i in range(30)}


def test_passages_are_whole(spark):
    """Every word of a repeated run of 51 words is returned, and no word outside a repeated run of 24."""
    random.seed(11)
    word = lambda n: [f"w{random.randint(0, 10**9)}" for _ in range(n)]
    passages = [word(n) for n in (50, 51, 60, 77, 200) for _ in range(8)]
    texts = [" ".join([*word(13), *p, *word(17)]) for p in passages] + [" ".join([*word(31), *p, *word(5)]) for p in passages]
    rows = spark.createDataFrame([*enumerate(texts), (1000, " ".join(passages[8])), (1001, " ".join(passages[8][:30]))], "doc_id long, text string").repartition(3)
    got = {}
    for r in paragraphs.repeated_passages(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["n_words"], r["kept_doc_id"]))
    for i, p in enumerate(passages):
        assert got.get(len(passages) + i) == [(31, len(p), i)]
    assert got[1000] == [(0, 51, 8)]
    assert not set(got) & set(range(len(passages)))
    # A text alone in its buffer has the pieces it has among others.
    import numpy as np
    alone = np.frombuffer(" ".join(passages[8]).encode(), np.uint8)
    assert len(paragraphs.pieces_of(alone, np.array([0, len(alone)]), np.array([5]))["at"])


def test_tuned_bands():
    bands, rows = paragraphs.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL and bands <= 12
    assert 1 - (1 - 0.8**sigtree.ROWS) ** sigtree.BANDS > 1 - 1e-9


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
