"""Classifiers, quality rules and token counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import linear, quality, quality_rules, queries, token_counts, toxicity
from locusframe.llm.queries import BYTE_RANKS

from .conftest import sentence

WS = r"[^\x20\x09-\x0D]+"


def base_statistics(text):
    words = re.findall(WS, text or "")
    seen = defaultdict(list)
    for k in range(len(words) - 4):
        seen[tuple(words[k : k + 5])].append(k)
    cover = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(WS, x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_as_brute_force(odd, odd_rows):
    got = quality_rules.assess(odd).collect()
    assert Counter((r.doc_id, *(r[f"q_{n}"] for n in NAMES)) for r in got) == Counter((r[0], *base_statistics(r[1])) for r in odd_rows)


def brute_rules(rows):
    """{doc_id: (kept, broken rules)} for rows of doc_id, text, lang and source."""
    cells, verdicts = {}, {}
    for i, text, _, _ in rows:
        text = text or ""
        n_words, chars, symbols, dup, repeat = base_statistics(text)
        n_lines = sum(bool(re.search(WS, x)) for x in text.split("\n"))
        upper, word = sum("A" <= c <= "Z" for c in text) / max(chars, 1), chars / max(n_words, 1)
        values = [symbols / max(n_words, 1), dup / max(n_lines, 1), repeat / max(n_words, 1), upper, word, word]
        cells[i] = [math.ceil(math.log(v) / math.log(quality_rules.GAMMA)) if v > 0 else None for v in values]
        verdicts[i] = n_words < 10 or 100 * repeat > 20 * n_words

    def quartiles(k, keep):
        found = sorted(cells[r[0]][k] for r in rows if keep(r) and cells[r[0]][k] is not None)
        return len(found), *(found[max(0, math.ceil(len(found) * q) - 1)] if found else None for q in (0.25, 0.75))

    out = {}
    for i, _, lang, source in rows:
        broken = []
        for k, (name, _, side) in enumerate(quality_rules.RULES):
            if cells[i][k] is None:
                continue
            own, mine, every = quartiles(k, lambda r: r[2:4] == (lang, source)), quartiles(k, lambda r: r[2] == lang), quartiles(k, lambda r: True)
            wider = mine if mine[0] >= quality_rules.MIN_GROUP else every
            _, low, high = own if own[0] >= quality_rules.MIN_GROUP else wider
            spread = max(high - low if own[0] >= quality_rules.MIN_GROUP else 0, wider[2] - wider[1])
            if cells[i][k] > high + quality_rules.SPREAD * spread if side == "high" else cells[i][k] < low - quality_rules.SPREAD * spread:
                broken.append(name)
        out[i] = (not verdicts[i] and not broken, broken)
    return out


def grouped_rows():
    """Two sources that differ in word lengths and capitals, a small one, and one without a language."""
    rng = random.Random(4)
    rows = []
    for i in range(330):
        source = ("short", "long", "short", "long", "rare")[i % 5] if i % 10 else None
        words = [("w" if source == "short" else "wonder") + "x" * rng.randrange(4) for _ in range(rng.randrange(8, 60))]
        words = [w.upper() if source == "long" and rng.random() < 0.3 else w for w in words]
        if i % 37 == 0:
            words = [w + "long" * 9 for w in words]
        if i % 41 == 0:
            words = [w.upper() for w in words]
        if i % 47 == 0:
            words = [w[0] for w in words]
        words[0] = words[0].upper()
        if i % 11 == 0:
            words = words[:12] * 2
        rows.append((i, "\n".join([" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]), None if i % 13 == 0 else "b" if source == "long" else "a", source))
    return [*rows, (900, None, "en", "short"), (901, "", None, None)]


def test_verdicts_as_brute_force(spark):
    rows = grouped_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: (r.kept, r.failed) for r in quality_rules.assess(df).collect()}
    expected = brute_rules(rows)
    assert got == expected
    assert len({tuple(f) for _, f in expected.values()}) >= 3


def test_no_fixed_cutoffs_give_these_verdicts(spark):
    """Words that are usual in one source are rejected in the other: no cutoff for both does that."""
    rng = random.Random(6)
    rows = [(i, " ".join(("w" if i % 2 else "wonderful") + "x" * rng.randrange(3) for _ in range(40)), "en", f"s{i % 2}") for i in range(600)]
    mixed = [(1000, rows[0][1], "en", "s1"), (1001, rows[1][1], "en", "s0")]
    # a language of its own for each source, or the wider spread of the language would hold for both
    rows = [(i, t, f"l{s}", s) for i, t, _, s in [*rows, *mixed]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.failed for r in quality_rules.assess(df).collect()}
    assert sorted(i for i, f in got.items() if f) == [1000, 1001]
    assert got[1000] == ["long_words"] and got[1001] == ["short_words"]


def test_sketches_merge(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 10 + id % 50), x -> concat('w', x, if(x % 3 = 0, '#', '')))) as text", "'en' as lang", "concat('s', id % 4) as source")
    stats = quality_rules._measured(quality_rules._plain(df, ("doc_id",))).cache()
    whole = quality_rules.sketches(stats.drop("g1").withColumn("g1", F.lit("all")))
    parts = quality_rules.sketches(stats)
    merged = parts.groupBy("g0", "rule", "cell").sum("n")
    assert Counter((r.g0, r.rule, r.cell, r.n) for r in whole.collect()) == Counter(map(tuple, merged.collect()))
    exact = np.quantile([r.v for r in stats.selectExpr(f"{quality_rules.RULES[0][1]} as v").collect()], 0.75, method="inverted_cdf")
    told = quality_rules.quartiles(whole, ("g0",)).where("rule = 0").collect()[0].high
    assert quality_rules.GAMMA**told == pytest.approx(exact, rel=0.011)


def test_salted_join_agrees(odd, monkeypatch):
    verdicts = lambda: Counter((r.doc_id, r.kept, tuple(r.failed)) for r in quality_rules.assess(odd).collect())
    plain = verdicts()
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert verdicts() == plain


def test_rules_on_odd_rows(odd, no_rows):
    clash = odd.selectExpr("*", "1 as q_n_words", "2 as g0", "3 as c1", "4 as salt", "'x' as failed", "5 as _lang", "6 as body", "7 as t_symbols")
    got = quality_rules.assess(clash, tuple(clash.columns)).collect()
    assert len(got) == odd.count() and all(not r.kept for r in got if r.q_n_words < 10)
    assert all((r["g0"], r["c1"], r["salt"], r["_lang"], r["body"], r["t_symbols"]) == (2, 3, 4, 5, 6, 7) for r in got)
    assert all(isinstance(r["failed"], list) for r in got)
    left = quality_rules.kept(clash)
    assert left.columns == clash.columns and Counter(r.doc_id for r in left.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.assess(no_rows).count() == 0 and quality_rules.kept(no_rows).columns == no_rows.columns


def test_lasso_finds_the_sparse_model():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 40)) < 0.3).astype(float)
    y = (rng.random(3000) < linear.sigmoid(-2 + 4 * x[:, 3] - 3 * x[:, 7])).astype(float)
    b, w, _ = linear.lasso_logistic(x, y, 0.01)
    assert set(np.argsort(-np.abs(w))[:2]) == {3, 7} and (np.abs(w) > 1e-9).sum() < 12
    rows = linear.Sparse(np.concatenate([[0], np.cumsum(x.sum(axis=1))]).astype(int), np.nonzero(x)[1], 40)
    assert np.allclose(linear.lasso_logistic(rows, y, 0.01)[1], w, atol=1e-6)


def labelled(spark, n=1200):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 90)).split()
        bad, toxic = i % 7 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyone", "nastytwo", "vile" + rng.choice("abcdefgh")]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rule_ensemble_on_held_out_rows(spark, odd, no_rows):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 60
    got = {r.doc_id: r for r in quality.scores(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [i for i, r in got.items() if r.held_out]
    assert 200 < len(out) < 400 and all((got[i].score >= 0.7) == truth[i] for i in out)
    assert all(0 <= r.score <= 1 for r in quality.scores(odd, model).collect())
    assert quality.scores(no_rows, model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scores(docs.limit(3), nothing).collect()} == {0.5}
    assert not any(x in quality.scores(docs, model)._jdf.queryExecution().toString() for x in ("Python", "Arrow"))


def test_chain_on_unseen_rows(spark, odd, no_rows):
    docs, labels = labelled(spark)
    marked = labels.selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    chain = toxicity.train(docs, marked.where("doc_id < 900"), ["low_quality", "toxic"])
    assert chain.categories == ["low_quality", "toxic"]
    assert [len(m[2]) for m in chain.models] == [0, 1]
    got = {r.doc_id: r for r in toxicity.probabilities(docs, chain).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    wrong = [i for i in range(900, 1200) if (got[i].p_toxic >= chain.cutoffs[1]) != truth[i]]
    assert len(wrong) <= 6 and all(truth[i] for i in wrong)
    assert toxicity.probabilities(odd, chain).count() == odd.count()
    assert toxicity.probabilities(no_rows, chain).count() == 0
    untrained = toxicity.train(docs, marked.limit(0), ["low_quality", "toxic"])
    assert all(abs(r.p_toxic - 0.5) < 0.1 for r in toxicity.probabilities(docs.limit(5), untrained).collect())


def test_out_of_fold_features_do_not_see_their_rows():
    """A bucket that marks the rows of one class, but only in one fold, is no feature for that fold."""
    n = 90
    folds, y = np.arange(n) % toxicity.FOLDS, (np.arange(n) // 3 % 2)[:, None]
    row = np.concatenate([np.arange(n), np.flatnonzero((folds == 0) & (y[:, 0] == 1))])
    bucket = np.concatenate([1 + y[:, 0], np.full(len(row) - n, 9)])
    rows = toxicity._Rows(row, bucket.astype(np.int32), y)
    assert rows.chosen(np.ones(n, bool))[9] >= 0 and rows.chosen(folds != 0)[9] < 0 and rows.chosen(folds != 1)[9] >= 0
    assert rows.chosen(folds != 0)[1] >= 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_quality"])
def test_queries_on_held_out_rows(spark, name):
    """The queries' own columns against labels that they haven't seen."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    out = [i for i in labels if got[i].held_out]
    if name == "op1_toxicity":
        wrong = [i for i in out if got[i].toxic != labels[i].toxic]
        assert all(0 <= got[i].p_toxic <= 1 and 0 <= got[i].p_low_quality <= 1 for i in got)
    else:
        wrong = [i for i in out if got[i].predicted != labels[i].quality]
        assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert len(out) > 50 and len(wrong) <= 0.08 * len(out)


def brute_tokens(model, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = (-1e18, 0)
        for start in range(end - 1, max(-1, end - 1 - model.longest), -1):
            score = model.score.get(word[start:end])
            if score is not None and best[start][0] + score > top[0]:
                top = (best[start][0] + score, best[start][1] + 1)
        best.append(top)
    return best[-1][1]


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 40, 0])
def test_token_counts_as_brute_force(odd, odd_rows, no_rows, frequent):
    """Also for counts that are joined, not broadcast; one pre-token has 50,000 letters."""
    model, split = token_counts._model(BYTE_RANKS, 2), token_counts._split()
    got = Counter((r.doc_id, r.n_bytes, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(odd, BYTE_RANKS, frequent=frequent).collect())
    memo = {}
    expected = Counter()
    for i, t, *_ in odd_rows:
        parts = split(t or "")
        for p in set(parts) - memo.keys():
            memo[p] = brute_tokens(model, p.encode())
        expected[i, len((t or "").encode()), len(parts), sum(memo[p] for p in parts)] += 1
    assert got == expected
    assert token_counts.token_counts(no_rows, BYTE_RANKS).count() == 0


def test_pretokens_of_the_corpus_are_scored_once(spark):
    texts = ["one two  three", "two\u00a0 three", "three\u00a0  four \u3000 x\x1c y", None, "", "\n\n a — b", "é"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = token_counts.vocabulary_counts(df, BYTE_RANKS).collect()
    expected = Counter(p for t in texts for p in token_counts._split()(t or ""))
    assert {bytes(r.pretoken).decode(): r.n for r in got} == expected and len(got) == len(expected)


def test_prefixes_are_scored_once():
    walk = token_counts.Walk(token_counts.Unigram(BYTE_RANKS))
    words = sorted([b"interact", b"interaction", b"interactions", b"internal", b"interactive", b"a" * 3000, b"a" * 2999])
    counts = {w: walk.tokens(w) for w in words}
    nodes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert walk.steps == len(nodes)
    assert all(counts[w] == brute_tokens(walk.model, w) for w in words if len(w) < 100)
