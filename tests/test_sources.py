from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioscope.operators import enrich, release
from folioscope.schema import PAPER
from folioscope.sources import mappings, queries, shards
from folioscope.streaming import ingest

COLUMNS = [f.name for f in PAPER.fields]


def one(spark, record, schema, mapping):
    df = mapping(mappings.parsed(spark.createDataFrame([(json.dumps(record),)], "value string"), schema))
    assert df.columns == COLUMNS and [f.dataType for f in df.schema.fields] == [f.dataType for f in PAPER.fields]
    return df.first()


def test_openalex(spark):
    work = {
        "id": "https://openalex.org/W1", "doi": "https://doi.org/10.1000/X", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/55"}, "display_name": " T ", "publication_year": 2001, "type": "article",
        "primary_location": {"source": {"display_name": "J", "issn_l": "1-1", "host_organization_name": "P"}}, "open_access": {"is_oa": False}, "abstract_inverted_index": {"b": [1], "a": [0, 2]},
        "authorships": [{"author": {"display_name": ""}}, {"author": {"display_name": "N", "orcid": "https://orcid.org/0"}, "institutions": [{"display_name": "I", "country_code": "NZ"}], "countries": ["AU"]}],
        "biblio": {"first_page": "1", "last_page": "9"}, "mesh": [{"descriptor_name": "M", "is_major_topic": True}, {"descriptor_name": None}], "concepts": [{"display_name": "C"}], "cited_by_count": 0,
        "funders": [{"funder_display_name": "F2"}, {"display_name": "F1"}],
    }
    r = one(spark, work, mappings.OPENALEX, mappings.openalex)
    assert (r["source_id"], r["doi"], r["pmid"], r["title"], r["abstract"], r["pages"], r["n_authors"]) == ("W1", "10.1000/x", "55", "T", "a b a", "1-9", 1)
    assert (r["authors"][0]["position"], r["countries"], r["mesh_major_terms"], r["keywords"], r["funders"], r["is_oa"], r["cited_by_count"]) == (2, ["AU", "NZ"], ["M"], ["C"], ["F1", "F2"], False, 0)
    empty = one(spark, {}, mappings.OPENALEX, mappings.openalex)
    assert (empty["title"], empty["abstract"], empty["n_authors"], empty["retracted"]) == ("", "", 0, False)


def test_europepmc(spark):
    record = {
        "id": "9", "source": "MED", "doi": "10.1000/X", "title": "On suicide.", "abstractText": "<h4>A</h4>b", "pubYear": "1999", "isOpenAccess": "Y", "pubTypeList": {"pubType": ["Retracted Publication"]},
        "authorList": {"author": [{"firstName": "A", "lastName": "B", "affiliation": "X"}, {"collectiveName": "G"}]}, "journalInfo": {"journal": {"title": "J", "essn": "2-2"}}, "keywordList": {"keyword": ["k", ""]},
    }
    r = one(spark, record, mappings.EUROPEPMC, mappings.europepmc)
    assert (r["title"], r["abstract"], r["year"], r["issn_l"], r["is_oa"], r["retracted"], r["topic_focus"]) == ("On suicide", "A b", 1999, "2-2", True, True, "focused")
    assert [a["name"] for a in r["authors"]] == ["A B", "G"] and r["affiliations_raw"] == ["X"] and r["keywords"] == ["k"] and r["url"].endswith("/MED/9")
    assert one(spark, {"pubYear": "n.d."}, mappings.EUROPEPMC, mappings.europepmc)["year"] is None


def test_scopus_and_wos(spark):
    r = one(spark, {"dc:identifier": "SCOPUS_ID:7", "prism:coverDate": "2004-05-06", "author-count": {"@total": "3"}, "authkeywords": "a | b |", "citedby-count": "4", "link": [{"@ref": "scopus", "@href": "u"}]}, mappings.SCOPUS, mappings.scopus)
    assert (r["source_id"], r["year"], r["n_authors"], r["keywords"], r["cited_by_count"], r["url"]) == ("7", 2004, 3, ["a", "b"], 4, "u")
    r = one(spark, {"uid": "W", "title": {"value": "T"}, "source": {"publishYear": 2005, "sourceTitle": "J"}, "identifiers": {"pmid": "MEDLINE:8"}, "citations": [{"db": "X", "count": 1}, {"db": "WOS", "count": 2}], "types": ["Article", "Review"]}, mappings.WOS, mappings.wos)
    assert (r["title"], r["year"], r["pmid"], r["cited_by_count"], r["doc_type_raw"], r["abstract"]) == ("T", 2005, "8", 2, "Article; Review", "")


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><ISSN IssnType="Electronic">9-9</ISSN><ISSN IssnType="Print">1-1</ISSN>
<JournalIssue><Volume>3</Volume><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title>Crisis</Title></Journal><ArticleTitle>On <i>suicide</i> rates.</ArticleTitle>
<Abstract><AbstractText Label="METHODS">We did.</AbstractText><AbstractText>Then.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName>
<Identifier Source="ORCID">https://orcid.org/0000-0001-2345-6789</Identifier><AffiliationInfo><Affiliation>Lab</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<Language>eng</Language><PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType><PublicationType UI="D2">Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Suicide</DescriptorName><QualifierName MajorTopicYN="Y">trends</QualifierName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="N">Adult</DescriptorName></MeshHeading></MeshHeadingList>
</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1000/AB</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Depression</ArticleTitle><ArticleDate><Year>2003</Year><Month>07</Month><Day>4</Day></ArticleDate></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_pubmed(spark):
    rows = spark.createDataFrame([(XML,), (XML,), ("no xml",)], "value string")
    got = {r["pmid"]: r for r in mappings.reparsed(rows).collect()}
    assert set(got) == {"11", "12"}
    r = got["11"]
    assert (r["title"], r["abstract"], r["year"], r["pub_date"], r["issn_l"], r["doi"]) == ("On suicide rates.", "Methods: We did. Then.", 1998, "1998", "1-1", "10.1000/ab")
    assert (r["mesh_terms"], r["mesh_major_terms"], r["topic_focus"], r["doc_type_raw"], r["n_authors"], r["authors"][0]["orcid"]) == (["Suicide", "Adult"], ["Suicide"], "focused", "Journal Article; Review", 2, "0000-0001-2345-6789")
    assert (got["12"]["year"], got["12"]["pub_date"], got["12"]["topic_focus"], got["12"]["abstract"]) == (2003, "2003-07-04", "peripheral", "")


def test_pubmed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.replace("<i>", "").replace("</i>", ""))
    assert {r["pmid"] for r in mappings.pubmed(mappings.read_pubmed_xml(spark, str(tmp_path / "a.xml"))).collect()} == {"11", "12"}


def test_shards(spark, tmp_path):
    for name, done in (("pubmed_1999", True), ("pubmed_2000", False), ("openalex_1999", True)):
        (tmp_path / f"{name}.ndjson").write_text(json.dumps({"source": name, "year": 1999, "unknown": 1}) + "\n\n")
        if done:
            shards.mark_complete(spark, str(tmp_path / f"{name}.ndjson"))
    df = shards.read_shards(spark, str(tmp_path))
    assert {r["channel"]: r["n"] for r in shards.channel_counts(df).collect()} == {"pubmed": 1, "openalex": 1}
    assert shards.read_shards(spark, str(tmp_path), ["openalex"]).count() == 1
    assert shards.read_shards(spark, str(tmp_path / "none")).count() == 0
    shards.write_shards(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    shards.write_csv(df.select("source", "authors"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_query_strings():
    assert queries.pubmed().startswith('(("Suicide"[MeSH Terms] OR ')
    assert queries.europepmc(["a", "b"], 1990, 1991) == '(TITLE:"a" OR TITLE:"b") AND (PUB_YEAR:[1990 TO 1991]) AND (HAS_ABSTRACT:Y)'
    assert queries.scopus(["a"], 1990) == '(TITLE("a")) AND PUBYEAR = 1990 AND DOCTYPE(ar OR re)'
    assert queries.wos(["a"], 1990) == '(TI=("a")) AND PY=(1990) AND DT=(Article OR Review)'
    assert "title.search:a%20OR%20b,type:article|review,has_abstract:true" in queries.openalex_topic(["a", "b"], "1990-01-01", "1990-12-31", ["article", "review"])
    assert queries.year_spans("1999-01-01", "2000-12-31") == [("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31")]

    def fetch(ids):
        if len(ids) > 2 or "bad" in ids:
            raise OSError
        return [{"pmid": i} for i in ids]

    assert set(queries.fetch_halving(["1", "2", "bad", "3", "3", "4", None], fetch)) == {"1", "2", "3", "4"}


def test_enrich(spark):
    df = spark.createDataFrame([("1", None, None), ("2", 0, "openalex"), (None, None, None), ("3", None, None)], "pmid string, cited_by_count int, citation_source string")
    m = spark.createDataFrame([("1", 7, 1.5), ("2", 9, None), ("1", 7, 1.5)], "pmid string, citation_count int, relative_citation_ratio double")
    got = {r["pmid"]: r for r in enrich.attach(df, m).collect()}
    assert (got["1"]["cited_by_count"], got["1"]["citation_source"], got["1"]["relative_citation_ratio"]) == (7, "icite", 1.5)
    assert (got["2"]["cited_by_count"], got["2"]["citation_source"]) == (0, "openalex")
    assert got["3"]["cited_by_count"] is None and got[None]["cited_by_count"] is None
    assert {r["pmid"]: r["cited_by_count"] for r in enrich.attach(df, m, overwrite=True).collect()}["2"] == 9
    assert enrich.report(df, enrich.attach(df, m)).first()["n_filled"] == 1


def test_release(spark, tmp_path):
    df = spark.createDataFrame([("r", "a", 1, "s", 2)], "record_id string, abstract string, meta_x int, label_source_methodology string, _w int")
    assert release.public(df).columns == ["record_id", "label_source_methodology"]
    release.write(df, str(tmp_path / "out"))
    sums = release.checksums(spark, str(tmp_path / "out")).where(F.col("path").endswith(".parquet")).collect()
    assert sums and all(len(r["sha256"]) == 64 for r in sums)
    assert release.rendered("{{a.b[1].c|.1f}} {{d}}", {"a": {"b": [0, {"c": 2.25}]}, "d": "x"}) == "2.2 x"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    paths = [str(src), str(tmp_path / "out"), str(tmp_path / "check")]
    (src / "a.ndjson").write_text(json.dumps({"source": "p", "doi": "10.1/a", "title": "T"}) + "\n" + json.dumps({"source": "p", "doi": "10.1/a", "title": "T"}) + "\n")
    ingest.ingest(spark, *paths).awaitTermination()
    (src / "b.ndjson").write_text(json.dumps({"source": "p", "doi": "10.1/a", "title": "T"}) + "\n" + json.dumps({"source": "q", "pmid": "4", "title": "U"}) + "\n")
    ingest.ingest(spark, *paths).awaitTermination()
    assert sorted(r["record_id"] for r in spark.read.parquet(paths[1]).collect()) == ["doi:10.1/a", "pmid:4"]


def test_stream_keeps_late_records(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    paths = [str(src), str(tmp_path / "out"), str(tmp_path / "check")]
    line = lambda doi, ts: json.dumps({"source": "p", "doi": doi, "title": "T", "harvest_ts": ts}) + "\n"
    for name, rows in (("a", line("10.1/a", "2026-06-01T00:00:00Z")), ("b", line("10.1/b", "2026-06-02T00:00:00Z")), ("c", line("10.1/c", "2025-11-01T00:00:00Z") + line("10.1/a", "2025-10-01T00:00:00Z"))):
        (src / f"{name}.ndjson").write_text(rows)
        ingest.ingest(spark, *paths).awaitTermination()
    assert sorted(r["record_id"] for r in spark.read.parquet(paths[1]).collect()) == ["doi:10.1/a", "doi:10.1/b", "doi:10.1/c"]
    ingest.ingest(spark, *paths[:2], str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 3
