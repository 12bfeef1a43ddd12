from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import similarity, text
from folioscope.operators import candidates, graph, linkage, venues
from folioscope.schema import PAPER


def paper(row_id, **values):
    return {"row_id": row_id, "source": "pubmed", "source_id": row_id, "title": "A study of many things in one place", "year": 2001, "journal_raw": "Journal of Things", "n_authors": 0, **values}


@pytest.fixture(scope="module")
def frame(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_id", T.StringType()), *PAPER.fields])

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return make


def plain_merges(edges, ids):
    """Clusters of pairs merged one after another; unlike identifiers refuse."""
    parent, held = {}, {k: tuple({x} - {None} for x in v) for k, v in ids.items()}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted(edges):
        a, b = sorted((root(a), root(b)))
        joined = tuple(x | y for x, y in zip(held[a], held[b]))
        if a != b and all(len(x) <= 1 for x in joined):
            parent[b], held[a] = a, joined
    return {x: root(x) for e in edges for x in e}


@pytest.mark.parametrize(("seed", "first"), [(1, 1000), (2, 2)])
def test_merging_in_rounds_is_merging_in_order(spark, monkeypatch, seed, first):
    """Hubs, chains and conflicts, also where a round takes up two pairs of a cluster only."""
    import random

    monkeypatch.setattr(linkage, "FIRST_PAIRS", first)
    rng = random.Random(seed)
    ids = {i: (rng.choice([None, None, "x", "y", "z"]), rng.choice([None, None, None, "1", "2"])) for i in range(18)}
    pairs = [sorted((rng.choice([0, 1, rng.randrange(18)]), rng.randrange(18))) for _ in range(34)]
    edges = {(a, b) for a, b in pairs if a < b and not any(p and q and p != q for p, q in zip(ids[a], ids[b]))}
    rows = [(a, b, ids[a][0], ids[b][0], ids[a][1], ids[b][1], "merge") for a, b in edges]
    matches = spark.createDataFrame(rows, "a long, b long, l_id_doi string, r_id_doi string, l_id_pmid string, r_id_pmid string, verdict string")
    got = {r["row_id"]: r["cluster"] for r in linkage.fuzzy_clusters(matches).collect()}
    assert got == plain_merges(edges, ids) and len(set(got.values())) > 3


@pytest.mark.parametrize("least", [80.0, 85.0, 92.0])
def test_the_index_finds_all_like_pairs(spark, monkeypatch, least):
    """Against all pairs: short and long texts, repeated grams, equal texts, blocks met in cells and through the index."""
    import random

    from folioscope.operators import candidates

    monkeypatch.setattr(candidates, "CELL", 30)
    rng = random.Random(5)
    bases = ["".join(rng.choice("aab c") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3)]
    texts = []
    for k in range(260):
        x = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, len(x) // 6])):
            x[rng.randrange(len(x)) : rng.randrange(len(x)) + 1] = rng.choice(["", "a", "bc"])
            x = x or ["a"]
        texts.append((k, k % 2 if k < 250 else 7, "".join(x)))
    texts += [(900, 0, ""), (901, 0, "")]
    own = spark.createDataFrame([*texts, (902, 1, None)], "row_id long, block int, title string")
    got = {(r["l_row_id"], r["r_row_id"]): r["score"] for r in linkage.scored_pairs(own, least).collect()}
    known = [(i, b, " ".join(sorted(x.split()))) for i, b, x in texts]
    want = {(i, j): plain_ratio(x, y) for i, b, x in known for j, c, y in known if i < j and b == c and plain_ratio(x, y) >= least}
    assert sorted(got.keys() ^ want.keys()) == []
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def works(frame, *rows):
    out, review, report = linkage.deduplicate(frame(*rows))
    return [r.asDict(recursive=True) for r in out.collect()], review.collect(), report.first()


def test_one_doi_two_sources(frame):
    got, _, report = works(frame, paper("a", doi="10.1/x", abstract="long"), paper("b", source="openalex", doi="10.1/x", cited_by_count=42, abstract="other"))
    assert len(got) == 1
    w = got[0]
    assert (w["cited_by_count"], w["abstract"], w["source"], w["record_id"]) == (42, "long", "openalex+pubmed", "doi:10.1/x")
    assert w["source_ids"] == {"pubmed": "a", "openalex": "b"} and report["duplicates_removed"] == 1


def test_chain_over_pmid(frame):
    got, _, _ = works(frame, paper("a", doi="10.1/x"), paper("b", source="openalex", doi="10.1/x", pmid="5"), paper("c", source="europepmc", pmid="5", abstract="text", title="Quite another title for the same work"))
    assert len(got) == 1 and got[0]["source"] == "europepmc+openalex+pubmed" and got[0]["abstract"] == "text"


def test_unlike_dois_stay_apart(frame):
    got, review, _ = works(frame, paper("a", doi="10.1/x"), paper("b", doi="10.1/y"))
    assert len(got) == 2 and not review


def test_fuzzy(frame):
    got, _, report = works(frame, paper("a", doi="10.1/x"), paper("b", title="A Study of Many Things, in One Place."))
    assert len(got) == 1 and report["fuzzy_merges"] == 1 and got[0]["doi"] == "10.1/x"


def test_same_title_elsewhere_is_for_review(frame):
    got, review, _ = works(frame, paper("a", doi="10.1/x", journal_raw="Journal of Things"), paper("b", journal_raw="Quarterly Report of Nothing At All"))
    assert len(got) == 2 and [r["reason"] for r in review] == ["title_match_without_corroboration"]


def test_transitive_conflict_is_refused(frame):
    got, _, _ = works(frame, paper("a", doi="10.1/x"), paper("b"), paper("c", doi="10.1/y"))
    assert sorted(w["doi"] for w in got) == ["10.1/x", "10.1/y"]


def test_best_tier_and_focus(frame):
    got, _, _ = works(frame, paper("a", doi="10.1/x", venue_tier="dispersed", topic_focus="peripheral", is_oa=False, cited_by_count=0), paper("b", doi="10.1/x", venue_tier="core_a", topic_focus="focused", n_authors=3))
    w = got[0]
    assert (w["venue_tier"], w["topic_focus"], w["n_authors"], w["is_oa"], w["cited_by_count"], w["retracted"]) == ("core_a", "focused", 3, False, 0, False)


def test_arithmetic_and_degenerate(frame):
    rows = [paper(f"r{i:02d}", doi=f"10.1/{i % 7}", title=f"Title number {i % 7} on subject {i % 7}") for i in range(21)]
    got, _, report = works(frame, *rows)
    assert len(got) == 7 == report["output_records"] and report["duplicates_removed"] == 14
    assert len(works(frame, paper("a"))[0]) == 1
    assert works(frame)[0] == []


def test_large_blocks_are_told(frame):
    rows = [paper(f"r{i:03d}", title=f"Study number {i:03d} of one and the same thing") for i in range(20)]
    assert linkage.candidate_pairs(frame(*rows), largest_block=10).count() == 0
    assert linkage.candidate_pairs(frame(*rows), largest_block=None).count() > 100


def test_large_blocks_are_compared_whole(frame):
    rows = [paper(f"r{i:03d}", title=f"Study {i * 7919 % 1000003:06d} {'abcdefghij'[i % 10] * (10 + i // 10)}") for i in range(410)]
    rows += [paper("x1", title="Study of near copies that stand in a hot block"), paper("x2", title="Study of near copies that stand in a hot blocks")]
    pairs = {(r["l_row_id"], r["r_row_id"]): r["score"] for r in linkage.candidate_pairs(frame(*rows)).collect()}
    assert ("x1", "x2") in pairs
    whole = linkage.candidate_pairs(frame(*rows), largest_block=1000).collect()
    assert len(whole) == len(pairs)
    got, _, _ = works(frame, *rows[-2:], *rows[:405])
    assert not {"x1", "x2"} <= {w["row_id"] for w in got}


@pytest.mark.parametrize("lot", [200_000, 3])
def test_components(spark, monkeypatch, lot):
    """Small lots leave the rounds of joins more to do."""
    monkeypatch.setattr(graph, "LOT", lot)
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20)] + [(100, 101 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 10 for i in range(10, 15)}, **{100 + i: 100 for i in range(51)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(200)]
    assert {r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_venues(spark):
    rows = [("Journal of Affective Disorders", "1-1")] * 3 + [("J Affect Disord", "1-1")] * 2 + [("J Affect Disord", None), ("Crisis", None), ("自杀学", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "journal_raw string, issn_l string")
    by_issn, by_key = venues.learn(df)
    got = {(r["journal_raw"], r["issn_l"]): (r["journal_canonical"], r["venue_method"]) for r in venues.resolve(df, by_issn, by_key).collect()}
    assert got["J Affect Disord", "1-1"] == ("Journal of Affective Disorders", "issn")
    assert got["J Affect Disord", None][1] == "exact_key" and got["J Affect Disord", None][0] in ("J Affect Disord", "Journal of Affective Disorders")
    assert got["自杀学", None] == ("自杀学", "new") and got[None, None] == ("", "unresolved")
    new = spark.createDataFrame([("Journal of Afective Disorders", None), ("Annals of Unknown Matters", None)], "journal_raw string, issn_l string")
    late = {r["journal_raw"]: (r["journal_canonical"], r["venue_method"]) for r in venues.resolve(new, by_issn, by_key).collect()}
    assert late["Journal of Afective Disorders"][1] == "fuzzy_auto" and late["Annals of Unknown Matters"] == ("Annals of Unknown Matters", "new")
    assert venues.normalisation_log(venues.resolve(df, by_issn, by_key)).agg(F.sum("n")).first()[0] == 10


def test_works_of_one_opening_and_unlike_bodies_stay_apart(spark, tmp_path):
    from folioscope.plans import catalogue

    opening = "This text is licensed under the terms that stand in the file next to it, and so on. "
    rows = [(i, opening + " ".join(f"{w}{i}" for w in ("river", "stone", "cloud", "meadow", "harbour") * 12), "en", "s", 30) for i in range(2)]
    rows += [(2, rows[0][1], "en", "s", 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["row_id"] for r in catalogue.linkage_works(spark, str(tmp_path)).collect()) == [0, 1]


# --- the whole of entity resolution against a plain version


def plain_ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for k, d in enumerate(b):
            new.append(row[k] + 1 if c == d else max(row[k + 1], new[k]))
        row = new
    return 100.0 * 2 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def plain_works(records):
    """(row_id, doi, pmid) of the works, by nested loops over records of one provider with plain titles."""
    parent = {r["row_id"]: r["row_id"] for r in records}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in records:
        for b in records:
            bare = not any((a["doi"], a["pmid"], b["doi"], b["pmid"])) and all(a[k] == b[k] for k in ("title", "year", "journal_raw"))
            if bare or (a["doi"] and a["doi"] == b["doi"]) or (a["pmid"] and a["pmid"] == b["pmid"]):
                x, y = sorted((root(a["row_id"]), root(b["row_id"])))
                parent[y] = x
    merged = []
    for x in sorted({root(r["row_id"]) for r in records}):
        own = sorted((r for r in records if root(r["row_id"]) == x), key=lambda r: r["row_id"])
        merged.append({k: next((r[k] for r in own if r[k]), None) for k in own[0]} | {"row_id": x})
    stops = ("the", "a", "an", "of", "and", "in", "on", "for", "to", "with")

    def block(r):
        telling = [w for w in r["title"].lower().split() if len(w) > 2 and w not in stops]
        return r["year"], telling[0][:6] if telling else "_"

    group = {r["row_id"]: r["row_id"] for r in merged}
    ids = {r["row_id"]: ({r["doi"]} - {None}, {r["pmid"]} - {None}) for r in merged}
    for i, a in enumerate(merged):
        for b in merged[i + 1 :]:
            x, y = a["title"].lower(), b["title"].lower()
            if block(a) != block(b) or min(len(x), len(y)) < 15 or plain_ratio(x, y) < 90 or any(a[k] and b[k] and a[k] != b[k] for k in ("doi", "pmid")):
                continue
            if a["issn_l"] and b["issn_l"]:
                sure = a["issn_l"] == b["issn_l"]
            elif a["journal_raw"] and b["journal_raw"]:
                sure = plain_ratio(a["journal_raw"].lower(), b["journal_raw"].lower()) >= 88
            else:
                sure = True
            p, q = (min(k for k in group if group[k] == group[r["row_id"]]) for r in (a, b))
            joined = tuple(s | t for s, t in zip(ids[p], ids[q]))
            if sure and p != q and all(len(s) <= 1 for s in joined):
                p, q = min(p, q), max(p, q)
                ids[p] = joined
                group = {k: p if g == q else g for k, g in group.items()}
    out = []
    for p in sorted(set(group.values())):
        own = [r for r in merged if group[r["row_id"]] == p]
        out.append((p, next((r["doi"] for r in own if r["doi"]), None), next((r["pmid"] for r in own if r["pmid"]), None)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_deduplicate_against_a_plain_version(frame, seed):
    import random

    rng = random.Random(seed)
    words = ["risk", "youth", "care", "means", "study", "trial", "cohort", "rates"]
    bases = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) for _ in range(12)]
    records = []
    for k in range(90):
        title = rng.choice(bases)
        if rng.random() < 0.4:
            title += rng.choice((" a", "s", " x y", " again"))
        records.append({
            "row_id": f"r{k:02d}", "title": title, "year": rng.choice((2000, 2001)), "journal_raw": rng.choice(("Journal of Things", "Journal of Thing", "Other Letters", None)),
            "doi": rng.choice((None, None, None, f"10.1/{k % 30}")), "pmid": rng.choice((None, None, None, None, str(k % 25))), "issn_l": rng.choice((None, None, "1-1", "2-2")),
        })
    got, _, _ = works(frame, *(paper(**r) for r in records))
    want = plain_works([{"authors": None, **r} for r in records])
    assert sorted((w["row_id"], w["doi"], w["pmid"]) for w in got) == want and len(want) < 80


def test_stars_need_no_rounds(spark, monkeypatch):
    """Edges of a single identifier are stars already, so no round of joins begins; edges that touch still take them."""
    from folioscope.operators import graph

    stars = spark.createDataFrame([(k - k % 10, k) for k in range(200) if k % 10], "a long, b long").repartition(7)
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long").repartition(7)
    rounds = []
    monkeypatch.setattr(graph, "_met", lambda many, one, key, total: rounds.append(key) or many.join(one.drop("n"), key))
    assert {tuple(r) for r in graph.components(stars).collect()} == {(k, k - k % 10) for k in range(200)} and not rounds
    assert {tuple(r) for r in graph.components(chain).collect()} == {(k, 0) for k in range(21)} and rounds


def test_copies_are_compared_and_keyed_once(spark, tmp_path):
    """Copies of part names are met as one name, and every pair of rows still comes out; an index of words is cut from a text without a shuffle."""
    from folioscope.plans import catalogue

    names = ["steel bolt", "steel bolts", "brass pipe", "steel bolt"] * 4
    spark.createDataFrame([(k, x, k % 3) for k, x in enumerate(names)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in catalogue.blocked_candidates(spark, str(tmp_path)).collect()}
    edits = {frozenset(("steel bolt", "steel bolts")): 1}
    want = {(i, j, 0 if x == y else edits[frozenset((x, y))]) for i, x in enumerate(names) for j, y in enumerate(names) if i < j and i % 3 == j % 3 and (x == y or frozenset((x, y)) in edits)}
    assert got == want
    spark.createDataFrame([(1, "b a  b"), (2, None), (3, " x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    index = catalogue.inverted_index_text(spark, str(tmp_path))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    import hashlib

    assert {tuple(r) for r in index.collect()} == {(1, hashlib.sha256(b"b a  b").hexdigest(), 3), (3, hashlib.sha256(b" x").hexdigest(), 2)}


def test_index_of_empty_texts_and_repeated_ids(spark, tmp_path):
    """An empty text is one empty word, and the rows of an id, null too, make one index, as in the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    from folioscope.plans import catalogue

    once = [(1, ""), (2, None), (3, "b a  b"), (4, " ")]
    for name, rows in {"once": once, "again": [*once, (1, ""), (2, "x y"), (3, "b a  b"), (5, "c d"), (5, "c"), (None, "p q"), (None, "p q r")]}.items():
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        got = {tuple(r) for r in catalogue.inverted_index_text(spark, f"{tmp_path}/{name}").collect()}
        assert got == set(con.sql(f"SELECT doc_id, linear_sha256, n_entries FROM ({catalogue.SQL['inverted_index_text']})").fetchall()) and len(got) == (3 if name == "once" else 6)


def test_pairs_of_copies_are_made_in_many_tasks(spark, monkeypatch):
    """Rows of few texts have many pairs: they come out whole, with all columns, from lots that are dealt over tasks, however little is shuffled."""
    monkeypatch.setattr(candidates, "COPIES", 20, raising=False)
    texts = ["a", "b", "c", "d"]
    rows = [(f"r{k:03d}", texts[k % 4] if k % 10 else "alone" + str(k), k % 2, k * 7) for k in range(300)]
    own = spark.createDataFrame([(i, f"block{x in 'abcd'}", v) for i, x, _, v in rows], "row_id string, block string, value int")
    firsts = {x: min(i for i, y, _, _ in rows if x == y) for x in {r[1] for r in rows}}
    first = spark.createDataFrame([(i, firsts[x]) for i, x, _, _ in rows], "row_id string, first string")
    near = {("a", "b"): 3, ("d", "b"): 5}
    like = spark.createDataFrame([("blockTrue", *sorted((firsts[x], firsts[y])), n) for (x, y), n in near.items()], "block string, l_row_id string, r_row_id string, score int")
    pairs = candidates.of_rows(own, like, first, equal=1).withColumn("task", F.spark_partition_id()).collect()
    score = lambda x, y: 1 if x == y else near.get((x, y), near.get((y, x)))
    want = {(a[0], b[0], a[3], b[3], float(score(a[1], b[1]))) for a in rows for b in rows if a[0] < b[0] and score(a[1], b[1])}
    assert sorted((r["l_row_id"], r["r_row_id"], r["l_value"], r["r_value"], r["score"]) for r in pairs) == sorted(want)
    share = Counter(r["task"] for r in pairs)
    assert len(share) >= 8 and max(share.values()) < 0.4 * len(pairs)


# --- long texts


def long_texts(n=90):
    """(row_id, block, x): made words in order, of lengths from 300 to 900, every third text a changed copy of an earlier one."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aaeeiinorstlmkwzéя") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    texts = []
    for i in range(n):
        own = rnd.choices(words, k=rnd.randint(60, 150)) if i % 3 or not texts else list(texts[rnd.randrange(len(texts))])
        for _ in range(i % 7 * 2 if i % 3 == 0 else 0):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        texts.append(own)
    return [(i, i % 9 // 8, " ".join(sorted(t))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least", [80.0, 90.0])
@pytest.mark.parametrize("side", [(1_000, 2_000_000), (4, 2_000_000), (1_000, 2_500)])
def test_long_pairs(spark, monkeypatch, least, side):
    """The same pairs and scores as by all pairs, also where classes of lengths are cut into parts."""
    monkeypatch.setattr(candidates, "SIDE_ROWS", side[0])
    monkeypatch.setattr(candidates, "SIDE_LETTERS", side[1])
    rows = long_texts()
    plain = {(a[0], b[0]): similarity.indel_ratio(a[2], b[2]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}
    plain = {k: v for k, v in plain.items() if v >= least}
    assert len(plain) > 10
    firsts = {x: i for i, _, x in reversed(rows)}
    df = spark.createDataFrame([r for r in rows if firsts[r[2]] == r[0]], "row_id long, block int, x string")
    got = candidates.like_pairs(df, least).collect()
    kept = {r[0] for r in df.collect()}
    assert len(got) == len({(r["l_row_id"], r["r_row_id"]) for r in got})
    assert {(r["l_row_id"], r["r_row_id"]): r["score"] for r in got} == {k: v for k, v in plain.items() if set(k) <= kept}


def test_long_unlike_texts_are_ruled_out_by_few_letters(monkeypatch):
    """Texts of one language that share no wording: under a tenth of the work of meeting all pairs whole."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("eeeeaaaoooiiitttnnnsssrrrhhlldducmfpgwybvkxjqz") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(sorted(rnd.choices(words, k=200))) for _ in range(30)]
    work = []
    real = similarity.lcs_lengths
    monkeypatch.setattr(similarity, "lcs_lengths", lambda a, others: work.append(len(a) * sum(map(len, others))) or real(a, others))
    cell = pa.table({"row_id": list(range(30)), "block": ["b"] * 30, "x": texts, "p": [0] * 30, "q": [0] * 30, "high": [False] * 30})
    assert candidates._like_in_cell(90.0)(cell).num_rows == 0
    assert sum(work) < 0.1 * sum(len(a) * len(b) for i, a in enumerate(texts) for b in texts[:i])


def test_lcs_lengths():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcd ") for _ in range(k)) for k in (0, 1, 64, 63, 200, 7, 0)]
    coded = [np.array([ord(c) for c in t], np.int32) for t in texts]
    for a, t in zip(coded, texts):
        assert similarity.lcs_lengths(a, coded).tolist() == [similarity.lcs_length(t, u) for u in texts]


def test_works_need_only_pairs_that_merge(frame):
    rows = [paper(f"r{i:02d}", doi=f"10.1/{i}" if i % 5 == 0 else None, title="Study of the many causes of one effect" + " in some detail"[: i * 2 % 16]) for i in range(12)]
    whole, _, _ = linkage.deduplicate(frame(*rows))
    some, review, _ = linkage.deduplicate(frame(*rows), least=linkage.AUTO_ACCEPT)
    assert sorted(map(str, whole.collect())) == sorted(map(str, some.collect()))
    assert review.where("score < 90").isEmpty()


def test_title_norm_of_every_character(spark):
    """The table of ASCII and the pattern for the rest do what one pattern does."""
    rows = [(i, f" <b>A{chr(i)}</b>  {chr(i)}{chr(i)}& <") for i in [*range(0x3100), 0xFFFD, 0x1F600, 0x1D400] if not 0xD800 <= i < 0xE000]
    t = F.lower(text.fold_accents(F.col("t")))
    t = F.replace(F.regexp_replace(t, "<[^>]+>", " "), F.lit("&"), F.lit(" and "))
    once = text.squeeze(F.regexp_replace(t, "[^a-z0-9\\s]", " "))
    assert spark.createDataFrame(rows, "i int, t string").where(text.title_norm(F.col("t")) != once).count() == 0
