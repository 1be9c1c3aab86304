"""Packing, sharding and archives: exact round trips and laws."""

import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from locusframe.llm import packing, runtime, sharding, warc
from locusframe.llm.queries import BYTE_BPE


def laid_out(rows):
    """The pieces of each sequence in order, after a look at their offsets."""
    sequences = defaultdict(list)
    for doc, start, total, ids, sequence, offset in rows:
        sequences[sequence].append((offset, doc, start, total, len(ids) // 4))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[4] for p in parts[:k]) for k in range(len(parts))]
    return sequences


def test_bins_are_harmonic():
    rng = np.random.default_rng(4)
    bins, capacity, rows, sizes = packing.Bins(60, 1), 60, [], {}
    for doc in range(3000):
        sizes[doc] = int(rng.integers(1, 200))
        rows += bins.put(doc, np.full(sizes[doc], doc, "<u4").tobytes())
    early = laid_out(rows)
    rows += bins.rest()
    by_doc = defaultdict(list)
    for doc, start, total, ids, _, _ in rows:
        assert total == sizes[doc] and set(np.frombuffer(ids, "<u4")) == {doc}
        by_doc[doc].append((start, len(ids) // 4))
    for doc, parts in by_doc.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == sizes[doc]
    assert by_doc.keys() == sizes.keys()
    uncut, classes = 0, set()
    for parts in early.values():  # bins of a class hold that many whole remainders and a filling
        assert sum(p[4] for p in parts) == capacity
        if len(parts) == 1:
            continue
        fit = capacity // parts[0][4]
        assert all(capacity // p[4] == fit and p[2] == p[3] - p[3] % capacity and p[4] == p[3] % capacity for p in parts[:fit])
        uncut, classes = uncut + fit, classes | {fit}
    assert {1, 2, 3, 4, 5, 6, 7} <= classes and uncut > 1800
    lengths = [sum(p[4] for p in parts) for parts in laid_out(rows).values()]
    assert all(n <= capacity for n in lengths) and sum(lengths) == sum(sizes.values())
    assert all(n == capacity or n & (n - 1) == 0 for n in lengths)


def test_packing_is_whole(odd, odd_rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    pieces = packing.pack(odd, BYTE_BPE, 256).collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        assert p.length == len(p.ids) // 4
    copies = Counter(r[0] for r in odd_rows)
    for doc, text in {r[0]: r[1] for r in odd_rows}.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        held = np.zeros(len(ids), int)
        for p in by_doc[doc]:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids)
            held[p.start : p.start + p.length] += 1
        assert (held == copies[doc]).all()
    for parts in laid_out((p.doc_id, p.start, p.doc_tokens, p.ids, p.sequence_id, p.offset) for p in pieces).values():
        total = sum(p[4] for p in parts)
        assert total <= 256 and total & (total - 1) == 0


def test_packing_of_added_tokens(spark):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    texts = ["a b<|endoftext|> c", "<|endoftext|>", "<|endoftext|><|endoftext|> \n  x", "one  <|endoftext|>two <|endoftext", "a <|END|> <| endoftext |>", " plain text,  with no such token ", "<|endoftext|> and words " * 400, "no\u00a0break\u3000 space \u00a0 ", "  two  \n\n three\t\t", "\x1c x \x85y", "it's 's don't  're", "\u200b \ufeff x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_doc = defaultdict(list)
    for p in packing.pack(df, BYTE_BPE, 256).collect():
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for doc, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert [x for _, part, _ in sorted(by_doc[doc]) for x in part] == ids
        assert all(n == len(ids) for _, _, n in by_doc[doc])


def test_packing_nothing(no_rows):
    assert packing.pack(no_rows, BYTE_BPE).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(no_rows, BYTE_BPE, 1000)


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "x" * (i * 37 % 211), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 7}", i * 37 % 211) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.kd_shards(df, 16).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][1]) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(16)) and len(got) == 4000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 5 * 212


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_other_shard_counts(spark, shards):
    df = spark.range(900).selectExpr("id as doc_id", "repeat('y', 20) as text", "'same' as source")
    size = Counter(r.shard for r in sharding.kd_shards(df, shards).collect())
    assert sorted(size) == list(range(shards)) and max(size.values()) - min(size.values()) <= shards


def test_sharding_odd_rows(odd, no_rows):
    got = sharding.kd_shards(odd, 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert sharding.kd_shards(no_rows, 4).count() == 0


def brute_tree(rows, shards, axes, numbered=False):
    """{row: leaf} for rows of (size, tie, position by axis...), by sorting each node's rows."""
    bits = sharding._TIE_BITS
    span = [max(1, max(r[2 + a] for r in rows) - min(r[2 + a] for r in rows)) for a in range(axes)]
    leaf = {}

    def split(part, k, path, first=0):
        if k == 1 or not part:
            number.update(dict.fromkeys(part, first))
            leaf.update({i: path + "0" * 9 if k == 1 else path for i in part})
            return
        wide = [(max(rows[i][2 + a] for i in part) - min(rows[i][2 + a] for i in part)) / span[a] for a in range(axes)]
        a = wide.index(max(wide))
        keys = Counter()
        for i in part:
            keys[rows[i][2 + a] << bits | rows[i][1]] += rows[i][0]
        goal, upto, cut = max(1, sum(keys.values()) * (k // 2) // k), 0, -1
        for key, size in sorted(keys.items()):
            if upto + size >= goal:
                cut = key if 2 * (goal - upto) >= size else key - 1
                break
            upto += size
        left = [i for i in part if rows[i][2 + a] << bits | rows[i][1] <= cut]
        right = [i for i in part if rows[i][2 + a] << bits | rows[i][1] > cut]
        split(left, k // 2, path + "0", first)
        split(right, k - k // 2, path + "1", first + k // 2)

    number = {}
    split(list(range(len(rows))), shards, "")
    if numbered:
        return number
    order = {p: n for n, p in enumerate(sorted(set(leaf.values())))}
    return {i: order[p] for i, p in leaf.items()}


@pytest.mark.parametrize("cells", [sharding.NODE_CELLS, 5])
def test_tree_as_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "NODE_CELLS", cells)
    rng = np.random.default_rng(8)
    sources = [f"https://long-common-prefix/{k:03d}" for k in range(37)]
    rows = [(i, "x" * int(rng.integers(0, 90)), None if i % 17 == 0 else ("en", "de", "fr")[i % 3], sources[0] if i % 3 else sources[int(rng.integers(0, 37))], int(rng.integers(0, 5000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(sharding.kd_shards(df, 11).collect(), key=lambda r: r.doc_id)
    assert [r.at_source for r in got] == [sorted({x[3] for x in rows}).index(x[3]) + 1 for x in rows]
    assert [r.at_lang for r in got] == [[None, "de", "en", "fr"].index(x[2]) for x in rows]
    expected = brute_tree([(r.size, r.tie, r.at_source, r.at_lang, r.at_n_chars) for r in got], 11, 3)
    assert [r.shard for r in got] == [expected[i] for i in range(1500)]


def test_many_values_are_joined_with_salt(spark, monkeypatch):
    df = spark.range(700).selectExpr("id as doc_id", "'t' as text", "if(id % 2 = 0, 'hot', concat('s', id)) as source")
    plain = Counter(map(tuple, sharding.kd_shards(df, 6).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_VALUES", 0)
    assert Counter(map(tuple, sharding.kd_shards(df, 6).collect())) == plain


def test_leaves_reach_the_target_bytes(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "repeat('y', 99) as text", "concat('s', id % 9) as source")
    size = Counter()
    for r in sharding.kd_shards(df, target_bytes=30_000).collect():
        size[r.shard] += r.size
    assert len(size) == 7 and max(size.values()) < 30_000
    with pytest.raises(ValueError, match="either"):
        sharding.kd_shards(df)


def test_sharding_is_native(odd):
    plan = sharding.kd_shards(odd, 4)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def page_rows():
    same = "<p>" + "equal payload " * 20 + "</p>"
    rows = [(i, f"http://x/{i}", same) for i in (9, 4, 7)] + [(1, None, None), (2, "u\r\nv", "short"), (3, "w", "short"), (4, "http://x/4", same)]
    rows += [(20 + i, f"http://y/{i}", f"<html>{i} é\r\n\r\nWARC/1.1\r\n" + "z" * (i * 5000) + "</html>") for i in range(12)]
    return [*rows, (None, "none", "é" * 60), (None, "none", same)]


def test_archives_round_trip(spark, page_rows, tmp_path):
    pages = spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write(pages, str(tmp_path))
    got = warc.read(manifest).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in page_rows)
    first = {}
    for i, _, html in page_rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    texts = defaultdict(set)
    for i, _, html in page_rows:
        texts[i].add((html or "").encode())
    for r in got:
        data = next(d for d in texts[r.page_id] if hashlib.sha256(d).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(data)
        revisit = data in first and r.page_id != first[data]
        assert (r.record_type, r.refers_to) == (("revisit", first[data]) if revisit else ("response", None))
        assert r.payload == (None if revisit else data)


def test_archives_begin_with_their_dictionary(spark, page_rows, tmp_path):
    pages = spark.createDataFrame(page_rows, "page_id long, url string, html string").coalesce(1)
    row = warc.write(pages, str(tmp_path)).collect()[0]
    data = open(row.path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(data[4:8], "little") == row.dictionary_bytes
    assert len(list(warc.frames(io.BytesIO(data), chunk=7))) == row.n_records == len(page_rows)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(io.BytesIO(data[:-3])))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_many_leaves(spark, monkeypatch):
    """Nearly as many leaves as rows, as brute force has it; nodes beyond the bound of a broadcast are joined with salt."""
    rng = np.random.default_rng(9)
    rows = [(i, "x" * int(rng.integers(0, 90)), "hot" if i % 3 == 0 else f"s{i % 7}", int(rng.integers(0, 5000))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    got = sorted(sharding.kd_shards(df, 300).collect(), key=lambda r: r.doc_id)
    expected = brute_tree([(r.size, r.tie, r.at_source, r.at_n_chars) for r in got], 300, 2, numbered=True)
    assert [r.shard for r in got] == [expected[i] for i in range(600)]
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    small = df.where("doc_id < 100")
    salted = Counter(map(tuple, sharding.kd_shards(small, 5).collect()))
    monkeypatch.undo()
    assert Counter(map(tuple, sharding.kd_shards(small, 5).collect())) == salted
    plan = sharding.kd_shards(small, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 5
