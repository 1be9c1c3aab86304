import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import collocations, runtime

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, rank int"


def by_hand(rows, least, longest=5, contained=100, top=2000):
    """Rows of the result, from counts of all phrases in dictionaries."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= contained * a:
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, s[2].decode(), -s[1], s[3], s[4], total[lang], -s[0]) for i, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(df, **more):
    got = collocations.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def prose(n, seed=4):
    """Texts of a skewed vocabulary with planted phrases; one language holds most of them."""
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([["new", "york", "stock", "exchange"], ["of", "the", "first", "five", "years"], ["ha", "ha", "ha", "ha"]])
        text = "".join(w + rng.choice(["  ", " ", " ", " ", "\t", ". ", ", ", "\n", "; "]) for w in words)
        rows.append((text, rng.choices(["en", "de", None, "und", ""], [12, 3, 1, 1, 1])[0]))
    return rows


@pytest.mark.parametrize("size", [{}, {"HELD": 50, "PART_BYTES": 300, "MAP_BITS": 8, "TOP_SALTS": 3}])
def test_collocations_as_by_hand(spark, monkeypatch, size):
    for name, value in size.items():
        monkeypatch.setattr(collocations, name, value)
    rows = prose(500)
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(7)
    got = mined(df, least=8, shards=3, top=25)
    assert got == by_hand(rows, 8, top=25) and len(got) > 40
    assert any(len(r[2].split(" ")) > 2 for r in got)


def test_other_parameters(spark):
    rows = prose(300, seed=5)
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert mined(df, least=5, longest=3, contained=60, top=30, shards=4) == by_hand(rows, 5, 3, 60, 30)


def test_many_languages_are_joined_with_salt(spark, monkeypatch):
    rows = [(t, f"l{i % 40}" if i % 3 else "hot") for i, (t, _) in enumerate(prose(300, seed=6))]
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert mined(df, least=4, shards=2) == by_hand(rows, 4)


def test_odd_rows_and_no_rows(spark, odd, odd_rows, no_rows):
    rows = [(r[1], r[2]) for r in odd_rows]
    assert mined(odd, least=3) == by_hand(rows, 3)
    assert mined(no_rows) == []
    assert mined(odd, least=10**9) == []


def test_shards_lower_the_support_in_proportion(spark):
    """A phrase that only one small shard knows well is still found, and rare ones are not counted."""
    rows = [("alpha beta " * 10, "en")] + [(f"x{i} y{i} z{i}", "en") for i in range(2000)]
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(6)
    assert {r[2] for r in mined(df, least=9, shards=6)} == {r[2] for r in by_hand(rows, 9)} != set()


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, low, r = 3_000_000_007, 9_000_000_000_000_011, 10**13 + 9, 10**14 + 7
    got = spark.sql(f"select (cast(1000 as decimal(4, 0)) * cast({a}L as decimal(15, 0)) * cast({n}L as decimal(19, 0))) div (cast({low}L as decimal(19, 0)) * cast({r}L as decimal(19, 0))) as s").collect()[0].s
    assert got == 1000 * a * n // (low * r)


def test_equal_hashes_are_told_apart_by_the_second():
    first, second = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 9], np.uint64)
    at, n = collocations._distinct(first, second)
    assert sorted(zip(first[at].tolist(), second[at].tolist(), n.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (7, 9, 1)]


def test_phrases_of_a_scan():
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"], "lang_key": [0, 1 << 16], "shard": [0, 1], "text": ["One  two\tthree. foür", "five six"]})
    scan = next(iter(collocations._scans(batch, {})))
    assert scan.phrases(np.array([0, 1]), 2).to_pylist() == ["one two", "two three"]
    assert scan.inside(2).tolist() == [True, True, False, False, True]
    assert scan.phrases(np.arange(6), 1).to_pylist() == ["one", "two", "three", "foür", "five", "six"]
