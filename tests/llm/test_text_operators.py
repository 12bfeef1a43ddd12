"""Substring dedup, SimHash, rules and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from plain import prose, words
from pyspark.sql import functions as F

from folioscope.llm import _text, fingerprints, quality_rules, simhash, substring_dedup
from folioscope.operators import graph


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- shared text views


def test_words_and_hashes(corpus):
    import pyarrow as pa

    texts = [t for _, t in corpus]
    data, offsets = _text.flat(pa.array(texts, pa.string()))
    start, end, first = _text.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(start[i:j], end[i:j])] for i, j in zip(first, first[1:])]
    assert got == [words(t) for t in texts]
    h = _text.word_hashes(data, start, end)
    by = {}
    for w, x in zip((w for g in got for w in g), h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    sliced = pa.array(texts, pa.string())[7:30]
    assert _text.flat(sliced)[0].tobytes().decode() == "".join(t or "" for t in texts[7:30])
    a = np.arange(40, dtype=np.uint64) % np.uint64(10)
    r = _text.rolling(a, 7)
    assert len(r) == 34 and (r[:24] == r[10:]).all() and len(set(r.tolist())) == 10


# --- substring dedup


def brute_dedup(corpus, window):
    first, out = {}, {}
    for i, t in sorted(corpus):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in corpus:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(docs, corpus, window):
    got = rows(substring_dedup.deduplicated(docs, window=window, keep=("fp",)))
    want = brute_dedup(corpus, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 200 and got[0]["fp"] == "x"


def test_substring_digests_and_small_chunks(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)  # many chunks: repeats are found across them
    monkeypatch.setattr(substring_dedup, "RANGE_HASHES", 300)
    got = rows(substring_dedup.dedup_digests(docs))
    for i, (n, gone, kept) in brute_dedup(corpus, 50).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("fan", "ranges"), [(3, 50), (1_024, 20_000_000), (2, 40_000_000)])
def test_substring_ranges_cut_twice(docs, corpus, monkeypatch, fan, ranges):
    """Ranges in two levels, as a table of 100 TB has them, find every link."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2_000)
    got = rows(substring_dedup._dedup(docs, "text", "doc_id", 50, True, fan=fan, least_ranges=ranges))
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in got.items()} == brute_dedup(corpus, 50)


def test_no_passage_is_lost_however_many_ranges():
    """200 planted passages through the passes' own functions, at range counts beyond any table's."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(31)
    passages = [prose(rng, 50, "abcdefghijklmnop") for _ in range(200)]
    left, right = ([f"{prose(rng, rng.randint(0, 30))} {p} {prose(rng, 9)}" for p in passages] for _ in range(2))
    for n in (1_000, 10_000_000, 16_000_000, 200_000_000):
        ranges = substring_dedup.Ranges.of(n, 1_000)
        packed = [substring_dedup._anchors(pa.table({"chunk": pa.array([k] * 200, pa.int32()), "text": t}), 25, ranges) for k, t in enumerate((left, right))]
        if ranges.fine > 1:
            merged = [substring_dedup._merged_anchors(t.slice(i, 1).append_column("lot", pa.array([t.column("chunk")[0].as_py()], pa.int32())), ranges) for t in packed for i in range(len(t))]
        else:
            merged = packed
        held = pa.concat_tables(merged)
        said = []
        for b in np.unique(held.column("bucket").to_numpy()):
            said.append(substring_dedup._answer_anchors(held.filter(pa.compute.equal(held.column("bucket"), b)), ranges))
        said = pa.concat_tables(said)
        for k, texts in enumerate((left, right)):
            own = said.filter(pa.compute.equal(said.column("chunk"), k))
            if ranges.fine > 1:
                coarse = pa.array(own.column("bucket").to_numpy() // ranges.fine)
                own = own.set_column(0, "bucket", coarse)
                own = pa.concat_tables([substring_dedup._routed_anchors(packed[k].filter(pa.compute.equal(packed[k].column("bucket"), b)), own.filter(pa.compute.equal(own.column("bucket"), b)), ranges) for b in np.unique(packed[k].column("bucket").to_numpy())])
            words_of = substring_dedup._Words.of(*_text.flat(pa.chunked_array([texts])))
            start = substring_dedup._candidates(words_of, own, 50, 25, ranges)
            assert len(np.unique(words_of.doc[start])) == 200, (n, k)


def test_substring_keys(spark, empty):
    text = prose(random.Random(1), 70)
    df = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (9, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.deduplicated(df).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 9, 70), (True, 0, 70), (True, 0, 70)]
    assert substring_dedup.deduplicated(empty).count() == 0


# --- SimHash


def brute_fingerprint(text, n=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, distance=4):
    ids, parent = list(fp), {i: i for i in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.fixture(params=[200_000, 2])
def lot(request, monkeypatch):
    """Components of which the edges are joined up in large and in small lots before rounds of joins."""
    monkeypatch.setattr(graph, "LOT", request.param)


def test_simhash(docs, corpus, empty, lot):
    got = rows(simhash.near_duplicates(docs).withColumn("hex", simhash.hexadecimal(F.col("fp"))))
    fp = {i: brute_fingerprint(t) for i, t in corpus}
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fp)
    assert got[61]["component_id"] == 3 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [8192, 40])
def test_links(spark, group):
    """Random fingerprints, chains and balls of near ones; small groups force the cut into parts."""
    rng = random.Random(4)
    pool = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(400):
        pool.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    x = rng.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        pool.add(x)
    fp = {n: n for n in pool}
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    df = spark.createDataFrame([(signed(n),) for n in pool], "fp long")
    edges = simhash.links(df, group=group)
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges.collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    want = brute_components(fp)
    found = simhash.components(edges)
    root = {signed(n): signed(n) for n in pool} | {r["node"]: r["root"] for r in found.collect()}
    groups = lambda f: sorted(sorted(g) for g in {r: [n for n in f if f[n] == r] for r in set(f.values())}.values())
    assert groups(root) == groups({signed(a): signed(b) for a, b in want.items()})


def test_large_group_gives_few_links(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(62)
    pool = {centre ^ sum(1 << b for b in rng.sample(range(60), 2)) for _ in range(1500)}
    edges = simhash.links(spark.createDataFrame([(n,) for n in pool], "fp long"))
    assert edges.count() <= 5 * len(pool)  # a spanning set for each block, not all pairs
    assert len({r["root"] for r in simhash.components(edges).collect()}) == 1


def test_simhash_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(False, False, 7), (False, False, 7), (True, False, 7), (True, True, None), (True, True, None)], key=repr)


def test_any_near_pair_shares_a_key():
    """For every number of agreeing blocks; keys grow with the number of fingerprints."""
    rng = random.Random(41)
    seen = set()
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash._masks(4, n)
        seen.add(len(masks))
        for _ in range(3_000):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            assert any((a ^ b) & m & (1 << 64) - 1 == 0 for m in masks)
    assert seen == {5, 15, 35, 70}


@pytest.mark.parametrize("fill", [0, 64])
def test_simhash_with_wider_keys(docs, corpus, monkeypatch, fill):
    monkeypatch.setattr(simhash, "FILL", fill)
    fp = {i: brute_fingerprint(t) for i, t in corpus}
    got = rows(simhash.near_duplicates(docs))
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fp)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """A join of which one key holds most rows: no row is lost or doubled, and the key's rows lie in many partitions."""
    monkeypatch.setattr(graph, "ROWS_A_TASK", 10_000)
    many = spark.range(60_000).select(F.when(F.col("id") < 40_000, 1).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left"):
            out = _text.spread_join(many, one.where("k <= 50000"), "k", 60_000, how)
            assert out.columns == ["k", "id", "least"] and out.count() == (60_000 if how == "left" else 50_001)
            assert out.where("k = 1 and least = 0").count() == 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("cell", [512, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, cell, lot):
    """Small cells force bands into parts that meet two by two."""
    monkeypatch.setattr(simhash, "CELL_TEXTS", cell)
    rng = random.Random(42)
    texts = []
    for _ in range(60):
        base = words(prose(rng, rng.choice((1, 4, 6, 30, 120))))
        for _ in range(6):
            own = list(base)
            for k in rng.sample(range(len(own)), min(len(own), rng.choice((0, 0, 1, 2, 4)))):
                own[k] = prose(rng, 1)
            texts.append(" ".join(own) + rng.choice(("", " ", " x")))
    texts = [t for t in dict.fromkeys(texts) if words(t)] + ["", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("node", simhash.text_node(F.col("text")))
    node = {r["i"]: r["node"] for r in df.collect()}
    root = {r["node"]: r["root"] for r in simhash.near_copies(df).collect()}
    got = {i: root.get(n, n) for i, n in node.items()}
    parent = {i: i for i in node}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for a in range(len(texts) - 2):
        for b in range(a + 1, len(texts) - 2):
            if jaccard(texts[a], texts[b]) >= 0.8:
                parent[find(a)], linked = find(b), linked + 1
    groups = lambda f: {frozenset(j for j in node if f(j) == f(i)) for i in node}
    assert linked > 40 and groups(lambda i: got[i]) == groups(lambda i: find(i) if i < len(texts) - 2 else -1)


def test_likeness_of_sets_block_by_block():
    import numpy as np

    rng = random.Random(43)
    base = rng.sample(range(1 << 40), 60)
    sets = [sorted(set(base) - set(rng.sample(base, rng.randint(0, 25))) | set(rng.sample(range(1 << 40), rng.randint(0, 9)))) for _ in range(30)]
    flat, at = np.concatenate([np.array(x) for x in sets]), np.cumsum([0, *map(len, sets)])
    want = [[len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for b in sets] for a in sets]
    for width in (4_096, 7):
        assert (np.triu(simhash._alike(flat, at, 0.8, width), 1) == np.triu(np.array(want), 1)).all()


# --- rules


def brute_rules(t):
    t = t or ""
    w = words(t)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, corpus, empty):
    extra = [(1000, "# * $ % & | < > and words"), (1001, "one two three four five six seven eight " * 3), (1002, "p q r s t u v w x p q r s t u v w")]
    df = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, fp string"))
    got = rows(quality_rules.measured(df))
    names = ("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words")
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == {i: brute_rules(t) for i, t in [*corpus, *extra]}
    judged = rows(quality_rules.judge(df))
    backwards = rows(quality_rules.cascade(quality_rules.measured(df), list(quality_rules.rules())[::-1]))
    assert {i: r["kept"] for i, r in judged.items()} == {i: r["kept"] for i, r in backwards.items()}
    assert sorted(quality_rules.plan(df)) == sorted(quality_rules.rules()) and quality_rules.judge(empty).count() == 0
    assert judged[1000]["failed_rule"] is not None and all((r["failed_rule"] is None) == r["kept"] for r in judged.values())


def test_rules_are_lazy_and_ordered_alike(spark, docs, corpus):
    """The same order in ten runs; the chain without measures judges as the one with them, whatever the order."""
    df = docs.select("doc_id", "text").withColumns({"kept": F.lit("mine"), "failed_rule": F.lit(1), "q_w": F.lit(2), "q_words": F.lit("x")})
    orders = [quality_rules.plan(df.repartition(k + 1)) for k in range(10)]
    assert all(o == orders[0] for o in orders)
    cost = quality_rules.costs(3_000, 500)
    assert cost["few_words"] < cost["symbols"] < cost["repeated_words"] and quality_rules.costs(3_000, 500, quality_rules.MEASURED)["repeated_words"] == quality_rules.COMPARED
    whole = rows(quality_rules.judge(df))
    for order in (orders[0], orders[0][::-1], sorted(orders[0])):
        lazy = rows(quality_rules.cascade(df, order))
        assert {i: r["kept"] for i, r in lazy.items()} == {i: r["kept"] for i, r in whole.items()}
        for i, t in corpus:
            n, chars, symbols, dup, repeat = brute_rules(t)
            w, t = words(t or ""), t or ""
            fails = {
                "few_words": n < 20, "repeated_words": repeat * 100 > n * 30, "symbols": symbols * 10 > n * 3, "short_words": chars < n * 2, "long_words": chars > n * 15,
                "echoes": sum(a == b for a, b in zip(w, w[1:])) * 10 > n * 3, "repeated_lines": dup * 2 > len(t.split("\n")), "shouting": t.count("!") * 10 > n * 5,
            }
            assert lazy[i]["failed_rule"] == next((k for k in order if fails[k]), None)
    assert rows(quality_rules.judge(docs.where("doc_id is null or doc_id < 5"), measures=False)).keys() == {0, 1, 2, 3, 4}


def test_rules_take_null_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    assert [r["failed_rule"] for r in quality_rules.judge(df).collect()] == ["few_words"] * 5


# --- fingerprints


def canonical(t):
    t = unicodedata.normalize("NFKC", t or "").upper().replace("ẞ", "SS").lower().replace("ς", "σ")
    return " ".join(t.split())


def test_canonical_form(spark):
    rng = random.Random(2)
    letters = [c for c in map(chr, [*range(0x20, 0x250), *range(0x300, 0x600), *range(0x1100, 0x1200), *range(0x1E00, 0x2100), *range(0x2100, 0x2200), *range(0xAC00, 0xAC80), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFF60)]) if unicodedata.category(c) not in ("Cn", "Cc", "Cf")]
    texts = ["", " a\n b ", "Straße STRASSE ẞ", "ΟΔΟΣ οδος", "é é", "ạ́ ạ́", "각 각", "ﬁ ½ … ²", "x y"]
    texts += ["".join(rng.choice(letters) for _ in range(8)) for _ in range(150)]
    texts += ["".join(rng.choice("aeọ́̈̄ ") for _ in range(10)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprints.canonical(F.col("text")).alias("c")).collect()
    wrong = [(texts[r["i"]], r["c"], canonical(texts[r["i"]])) for r in df if r["c"] != canonical(texts[r["i"]])]
    assert not wrong, wrong[:5]


def test_edit_report(docs, corpus, empty):
    got = rows(fingerprints.edit_report(docs))
    texts = dict(corpus)
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt)))
    by = {}
    for i, r in got.items():
        assert by.setdefault(canonical(texts[i]), r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by) and fingerprints.edit_report(empty).count() == 0


def test_next_is_right_however_it_is_cut(spark):
    ids = random.Random(8).sample(range(10_000), 300)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    order = sorted(ids, reverse=True)
    for n in (1, 2, 17, 64):
        got = {r["doc_id"]: r["next"] for r in fingerprints.with_next(df, buckets=n).collect()}
        assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}
    one = fingerprints.with_next(df.limit(1)).first()
    assert one["next"] == one["text"]
    nulls = spark.createDataFrame([(None, "n"), (3, "c"), (None, "n"), (2, "b"), (2, "b")], "doc_id long, text string")
    assert sorted(r["next"] for r in fingerprints.with_next(nulls, buckets=3).collect()) == ["b", "b", "c", "n", "n"]


def test_forms_that_share_a_digest_stay_apart(docs, corpus, monkeypatch):
    """With a digest that says nothing, bytes decide."""
    monkeypatch.setattr(fingerprints, "digest", lambda x: F.substring(F.md5(x), 1, 1))
    got = rows(fingerprints.exact_groups(docs))
    first = {}
    for i, t in corpus:
        first.setdefault(canonical(t), i)
    assert {i: r["group_id"] for i, r in got.items()} == {i: first[canonical(t)] for i, t in corpus}
    texts = dict(corpus)
    order = sorted(texts, reverse=True)
    report = rows(fingerprints.edit_report(docs))
    assert {i: report[i]["near_next"] for i in order} == {i: float(canonical(texts[i]) == canonical(texts[order[(k + 1) % len(order)]])) for k, i in enumerate(order)}


def test_report_and_groups_of_odd_rows(spark, empty):
    """Null keys, repeated rows and null texts; an empty table."""
    df = spark.createDataFrame([(None, "A b"), (None, "A b"), (3, "a  B"), (2, None), (2, ""), (2, "x y z"), (2, "x y z")], "doc_id long, text string")
    groups = sorted(((r["doc_id"] or 0, r["group_id"]) for r in fingerprints.exact_groups(df).collect()), key=str)
    assert groups == [(0, 3), (0, 3), (2, 2), (2, 2), (2, 2), (2, 2), (3, 3)]
    report = [tuple(r) for r in fingerprints.edit_report(df).collect()]
    assert len(report) == 7 and sorted(r[1] for r in report) == [0, 0, 3, 3, 4, 5, 5] and fingerprints.exact_groups(empty).count() == 0
    alone = spark.createDataFrame([(None, "q")], "doc_id long, text string")
    assert fingerprints.exact_groups(alone).first()["group_id"] is None and fingerprints.edit_report(alone).first()["near_next"] == 1.0


def test_composition_of_long_marked_texts(spark):
    """Decomposed Vietnamese, Hindi and marks without a letter, whole texts."""
    rng = random.Random(44)
    viet = " ".join("".join(rng.choice("aăâeêioôơuưydđnhctg") + rng.choice(("", "", "\u0300", "\u0301", "\u0309", "\u0323\u0302")) for _ in range(4)) for _ in range(3_000))
    hindi = " ".join("".join(rng.choice("कखगघचछजटडतदनपबमयरलवशसह") + rng.choice(("", "ा", "ि", "़", "्", "़ं")) for _ in range(4)) for _ in range(2_000))
    texts = [viet, unicodedata.normalize("NFD", viet), hindi, "\u0301\u0323 a\u0301\u0323", "a\x01\u0301", "\u09c7\u09be \u0bc6\u0bbe", "e\u0301e\u0301\u0323e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprints.canonical(F.col("text")).alias("c")).collect()
    assert [r["i"] for r in df if r["c"] != canonical(texts[r["i"]])] == []


@pytest.mark.parametrize("sent", [500_000, 0])
def test_exact_groups(docs, corpus, monkeypatch, sent):
    """Hashes of shared texts sent along, and met in a shuffle."""
    monkeypatch.setattr(fingerprints, "MOST_SENT", sent)
    got = rows(fingerprints.exact_groups(docs))
    first = {}
    for i, t in corpus:
        first.setdefault(canonical(t), i)
    assert {i: r["group_id"] for i, r in got.items()} == {i: first[canonical(t)] for i, t in corpus}
