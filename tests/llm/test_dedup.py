"""Line dedup, n-gram join and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusframe.llm import decontaminate, line_dedup, ngram_join
from locusframe.llm.textscan import shingle_sets, slices

from .conftest import sentence


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered)


def shingles(text):
    w = plain_words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def lines_left(rows, min_docs):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key := line_dedup.line_key(line.encode()):
                docs[key].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(docs[line_dedup.line_key(x.encode())]) < min_docs]
        out[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def with_lines(odd_rows):
    rng = random.Random(3)
    common = [f"Common line {k}" for k in range(6)]
    rows = [(r[0], r[1]) for r in odd_rows]
    for i in range(100, 160):
        own = [sentence(rng, 6) for _ in range(rng.randrange(4))]
        some = [rng.choice([c, c.upper(), f"  {c}\t"]) for c in rng.sample(common, rng.randrange(4))] + ["Always"] * rng.randrange(1, 3)
        lines = own + some + [""] * rng.randrange(2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_as_brute_force(spark, with_lines):
    df = spark.createDataFrame(with_lines, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(df, 10).collect()
    digest = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got)
    assert digest == lines_left(with_lines, 10)


def test_first_lines_stay(spark):
    rows = [(i, f"shared\nown {i}\nshared") for i in range(12)]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, keep_first=True).collect()}
    assert kept[0] == "shared\nown 0" and all(kept[i] == f"own {i}" for i in range(1, 12))


def test_bitmaps_are_compressed_bits(spark):
    rows = [(i, "\n".join(["same"] * 900 + [str(i)])) for i in range(10)]
    got = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[0].dropped), np.uint8), bitorder="little")
    assert len(got) == 10 and len(got[0].dropped) < 40 and bits[:900].all() and not bits[900:].any()


def test_different_texts_of_one_document(spark, no_adaptive):
    """A key is in as many documents as have it, however many texts or rows of these do."""
    rows = [(i % 8, f"often\nown {i}" if i % 3 else f"own {i}\nOFTEN\noften ") for i in range(400)] + [(i, "ten") for i in range(10)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_dedup.dedup_lines(df, 10).collect())
    assert got == lines_left(rows, 10)
    assert sum(n for (_, _, dropped, _), n in got.items() if dropped) == 30


@pytest.fixture
def no_adaptive(spark):
    """Eight partitions of ranges, as they are dealt."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_keep_columns(odd, no_rows):
    more = odd.selectExpr("*", "1 as text_key", "2 as body", "3 as doc", "4 as key", "5 as c0", "6 as n_lines", "7 as doc_marked")
    got = line_dedup.dedup_lines(more, 2)
    assert set(got.columns) == {*more.columns, "n_dropped"} and got.count() == odd.count()
    rows = got.collect()
    assert all((r["text_key"], r["body"], r["doc"], r["key"], r["c0"], r["doc_marked"]) == (1, 2, 3, 4, 5, 7) for r in rows)
    assert Counter((r["doc_id"], r["dropped"], r["lang"]) for r in rows) == Counter((r["doc_id"], r["dropped"], r["lang"]) for r in odd.collect())
    assert all(r["n_lines"] == (1 if r["text"] is None else r["n_lines"]) for r in rows)
    assert line_dedup.dedup_lines(no_rows).count() == 0


def brute_links(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    n = Counter(i for i, _ in rows if i is not None)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {i: n[i] - 1 if sets[i] else 0 for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += n[b]
                links[b] += n[a]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.fixture(scope="module")
def near_rows(odd_rows):
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in odd_rows]
    at = 1000
    for size in (2, 3, 12, 300):
        words = sentence(rng, 150).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    passage = sentence(rng, 60)
    for _ in range(40):
        rows.append((at, f"{sentence(rng, 50)} {passage} {sentence(rng, 50)}"))
        at += 1
    return rows


def test_links_as_brute_force(spark, near_rows):
    df = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_duplicates(df).collect()
    expected = brute_links(near_rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == expected
    assert len(got) == sum(1 for i, _ in near_rows if i is not None)
    kept = ngram_join.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c, _ in expected.values()})


def test_near_duplicates_of_odd_rows(odd, no_rows):
    assert ngram_join.near_duplicates(odd).count() == odd.where("doc_id is not null").count()
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert ngram_join.near_duplicates(no_rows).count() == 0


def test_prefixes_shorten_until_the_recall():
    assert [ngram_join.shortened([0.8], 8, 32, r) for r in (0.9, 0.999, 0.9999, 1.0)] == [8, 7, 6, 1]
    assert [ngram_join.shortened([1.0, s], 8) for s in (0.95, 0.9, 0.85, 0.8, 0.5)] == [8, 8, 8, 6, 1]


def mutated(rng, words, n):
    """A copy with a block of n words at the end replaced, so that n shingles are lost and n new."""
    return " ".join(words[: len(words) - n] + [f"new{rng.randrange(10**9)}" for _ in range(n)])


@pytest.mark.parametrize(("changed", "depths"), [(4, [8]), (20, [8, 6])])
def test_depths_follow_the_links(spark, changed, depths):
    """Copies that agree in nearly all shingles need no shorter prefixes; those just at the threshold do."""
    rng = random.Random(changed)
    rows = []
    for k in range(60):
        words = sentence(rng, 200, 10**6).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, mutated(rng, words, changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = ngram_join._Classes(df, 0.8)
    found = known.named(known.links(counts=True))
    assert known.rounds == depths
    assert {r.doc_id: (r.class_id, r.links) for r in found.collect()} == brute_links(rows)


def test_nodes_of_a_forest(spark):
    """Prefixes shared with a neighbour in the sorted order are those shared with any other."""
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (400, ngram_join.TREES, ngram_join.DEPTH)).astype(">u2")
    rows = [(i, x.tobytes()) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "rep long, signatures binary").repartition(4)
    got = {(r.tree, r.rep): r.shared for r in ngram_join.forest(df).collect()}
    less = 0
    for tree in range(ngram_join.TREES):
        values = [tuple(x) for x in labels[:, tree].tolist()]
        for depth in range(1, ngram_join.DEPTH + 1):
            n = Counter(v[:depth] for v in values)
            for i, v in enumerate(values):
                if n[v[:depth]] > 1:
                    assert got[tree, i] >= depth
                else:
                    less += got.get((tree, i), 0) >= depth
    assert less <= 8 * 2 * ngram_join.DEPTH  # rows at the ends of partitions


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(14)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (3, "other words only here and now"), (1, a), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (1, 1, 1), (3, 1, 1), (3, 3, 0), (4, 4, 0)])
    assert Counter(map(tuple, ngram_join.keep_one(df).collect())) == Counter([(1, a), (1, b), (3, "other words only here and now"), (4, "")])


def test_blocks_of_a_large_group(spark, monkeypatch):
    """With tiny blocks a group spans many, and nodes and blocks are dealt; the result is the same."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "DEAL", 3)
    rng = random.Random(21)
    words, rows = sentence(rng, 120).split(), []
    for i in range(150):
        copy = list(words)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_links(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()} == expected
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == sorted({c for c, _ in expected.values()})


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    share = []
    for _ in range(30):
        common = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        share.append((ngram_join.signature(a, 32, 6) == ngram_join.signature(b, 32, 6)).mean())
    assert abs(np.mean(share) - 0.8) < 0.02


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)]
    edges = spark.createDataFrame(path, "rep long, other long")
    got = {r.id: r.root for r in ngram_join.connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def brute_leaks(docs, items, threshold=0.8):
    best = {}
    for item, text in items:
        w = plain_words(text)
        if len(w) < 5:
            continue
        own = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for i, t in docs:
            d = plain_words(t)
            for k in range(5 - len(w), len(d) - 4):
                part = d[max(k, 0) : k + len(w)]
                c = Counter(tuple(part[j : j + 5]) for j in range(len(part) - 4))
                both = sum((c & own).values())
                if both and (s := both / (sum(c.values()) + sum(own.values()) - both)) >= threshold:
                    best[i, item] = max(best.get((i, item), 0), s)
    return best


@pytest.fixture
def no_broadcasts(spark):
    """Joins are broadcast only where the code says so."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_with_hot_roots(spark, no_broadcasts):
    """Two stars of 3,000 leaves, joined by a leaf, and a third of 2,000 whose middle isn't its least node."""
    edges = [(0, i) for i in range(1, 3_001)] + [(5_000, i) for i in range(5_001, 8_001)] + [(3_000, 8_000)] + [(20_000, i) for i in range(12_000, 14_000)]
    got = {r.id: r.root for r in ngram_join.connected(spark.createDataFrame(edges, "rep long, other long")).collect()}
    assert got == {i: 0 for i in [*range(3_001), *range(5_000, 8_001)]} | {i: 12_000 for i in [*range(12_000, 14_000), 20_000]}


def test_a_line_that_a_third_of_all_documents_share(spark, no_broadcasts):
    rows = [(i, f"own {i}\nshared by many\npair {i // 12}" if i % 3 == 0 else f"own {i}\npair {i // 12}") for i in range(4_500)]
    dropped = {r.doc_id: np.unpackbits(np.frombuffer(zlib.decompress(r.dropped), np.uint8), bitorder="little").nonzero()[0].tolist() for r in line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert dropped == {i: [1, 2] if i % 3 == 0 else [1] for i in range(4_500)}


def test_leaks_as_brute_force(spark, odd_rows):
    rng = random.Random(2)
    items = [(k, sentence(rng, rng.randrange(8, 70), 3000)) for k in range(30)] + [(90, None), (91, "too short"), (92, "five words are just enough")]
    docs = [(r[0], r[1]) for r in odd_rows if r[0] not in (9, None)]
    docs = list(dict(docs).items())
    for k in range(60):
        item = rng.choice(items[:30])[1].split()
        if k % 3 == 1:
            item = item[1:]
        if k % 3 == 2:
            item[len(item) // 2] = "changed"
        docs.append((500 + k, f"{sentence(rng, rng.randrange(30), 3000)}, {' '.join(item).title()}. {sentence(rng, rng.randrange(90), 3000)}"))
    docs.append((900, "five words are just enough"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    expected = brute_leaks(docs, items)
    assert got.keys() == expected.keys() and len(expected) > 30
    assert all(0.8 <= got[k] <= expected[k] + 1e-9 for k in got)  # of the windows that lie along the item
    kept = {r.doc_id for r in decontaminate.without_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in expected}


def leaks_of(docs, items):
    """What an index finds in texts, without Spark: {(document, item): similarity}."""
    import pyarrow as pa

    index = decontaminate.Index([i for i, _ in items], [t for _, t in items])
    found = {}
    for part in slices(pa.array([t for _, t in docs], pa.string()), decontaminate.SLICE):
        found |= {(docs[k][0], item): s for k, item, s, _, _ in index.search(part, 0.8)}
    return found


def test_items_cut_off_at_the_ends_of_texts():
    rng = random.Random(23)
    docs, items, expected = [], [], {}
    for n in (5, 9, 16, 25, 38, 50, 59, 120):  # nearly each a size class of one length, so its own shortest item
        item = sentence(rng, n, 3000).split()
        items.append((n, " ".join(item)))
        for cut in sorted({0, 1, (n - 4) // 10, (n - 4) // 5}):
            before, after = sentence(rng, 40, 3000), sentence(rng, 40, 3000)
            left, right = " ".join(item[cut:]), " ".join(item[: n - cut])
            for text in (left, right, f"{left} {after}", f"{before} {right}", f"{before} {left} {after}", f"{before} {right} {after}"):
                docs.append((len(docs), text))
                expected |= brute_leaks(docs[-1:], items[-1:])
    assert leaks_of(docs, items).keys() == expected.keys() and len(expected) > 120


def test_edits_just_within_the_similarity():
    rng = random.Random(41)
    docs, items, expected = [], [], {}
    for n in (25, 50, 59, 120, 200):
        for vocabulary in (2, 3000):  # two words: shingles repeat
            for _ in range(5):
                item = sentence(rng, n, vocabulary).split()
                items.append((len(items), " ".join(item)))
                size = max(1, (n - 4) // 9 - 4)
                for at in (0, rng.randrange(n - size), n // 2 - size, n - size):
                    for lost in (0, size):
                        text = " ".join(item[:at] + sentence(rng, size, 3000).split() + item[at + lost :])
                        docs.append((len(docs), f"{sentence(rng, 30, 3000)} {text} {sentence(rng, 30, 3000)}"))
                        expected |= brute_leaks(docs[-1:], items[-1:])
    own = {i: k // 8 for k, (i, _) in enumerate(docs)}
    got = {k: s for k, s in leaks_of(docs, items).items() if own[k[0]] == k[1]}
    assert got == expected and len(expected) > 250


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([1], [sentence(random.Random(1), 40)])
    base, known, places, tables = index.classes[0]
    flips = np.zeros(2000, np.uint64)
    for k in range(len(flips)):
        for bit in rng.choice(64, k % 20, replace=False):
            flips[k] |= np.uint64(1) << np.uint64(bit)
    window, entry = index.near(known[0] ^ flips, known, tables)
    assert {w for w, e in zip(window, entry, strict=True) if e == 0} == {k for k in range(len(flips)) if k % 20 <= decontaminate.RADIUS}


def test_decontamination_of_odd_rows(spark, odd, no_rows):
    bench = spark.createDataFrame([(1, "four words are here now")], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.without_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(no_rows, bench).count() == 0


def test_shingle_sets(odd_rows):
    import pyarrow as pa

    texts = [r[1] for r in odd_rows]
    sets = [s for p in slices(pa.array(texts, pa.string()), 4096) for s in shingle_sets(p)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
