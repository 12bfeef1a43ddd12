"""Providers' records as canonical ones: each mapping is one projection over nested columns.

Input is JSON text, one record a row in column `value` (or parsed rows of the schemas below); output has the columns
of folioscope.schema.PAPER in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.schema import PAPER

_NAMED = "array<struct<display_name:string>>"
OPENALEX = (
    "id string, doi string, ids struct<pmid:string>, display_name string, publication_year int, publication_date string, type string, language string,"
    "primary_location struct<source:struct<display_name:string,issn_l:string,host_organization_name:string>>, open_access struct<is_oa:boolean>,"
    "authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string,country_code:string>>,countries:array<string>>>,"
    "cited_by_count int, referenced_works_count int, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, is_retracted boolean,"
    f"abstract_inverted_index map<string,array<int>>, concepts {_NAMED}, keywords {_NAMED}, mesh array<struct<descriptor_name:string,is_major_topic:boolean>>,"
    "funders array<struct<display_name:string,funder_display_name:string>>"
)
EUROPEPMC = (
    "id string, source string, doi string, pmid string, title string, abstractText string, pubYear string, firstPublicationDate string, electronicPublicationDate string, pageInfo string,"
    "language string, isOpenAccess string, citedByCount int, pubTypeList struct<pubType:array<string>>, keywordList struct<keyword:array<string>>,"
    "journalInfo struct<volume:string,issue:string,journal:struct<title:string,issn:string,essn:string>>,"
    "authorList struct<author:array<struct<fullName:string,collectiveName:string,firstName:string,lastName:string,affiliation:string,authorId:struct<type:string,value:string>,"
    "authorAffiliationDetailsList:struct<authorAffiliation:array<struct<affiliation:string>>>>>>,"
    "meshHeadingList struct<meshHeading:array<struct<descriptorName:string,majorTopic_YN:string>>>"
)
SCOPUS = (
    "`dc:identifier` string, `prism:doi` string, `pubmed-id` string, `dc:title` string, `dc:description` string, `prism:publicationName` string, `prism:issn` string, `prism:eIssn` string,"
    "`prism:coverDate` string, `prism:volume` string, `prism:issueIdentifier` string, `prism:pageRange` string, subtypeDescription string, openaccessFlag boolean,"
    "author array<struct<authname:string,`ce:indexed-name`:string,orcid:string>>, `author-count` struct<`@total`:string>,"
    "affiliation array<struct<affilname:string,`affiliation-country`:string>>, authkeywords string, `citedby-count` string, link array<struct<`@ref`:string,`@href`:string>>"
)
WOS = (
    "uid string, title string, types array<string>, source struct<sourceTitle:string,publishYear:string,publishMonth:string,volume:string,issue:string,pages:struct<range:string>>,"
    "names struct<authors:array<struct<displayName:string,wosStandard:string,researcherId:string>>>, identifiers struct<doi:string,issn:string,eissn:string,pmid:string>,"
    "keywords struct<authorKeywords:array<string>>, citations array<struct<db:string,count:int>>, links struct<record:string>"
)
ICITE = (
    "pmid string, year int, citation_count int, relative_citation_ratio double, nih_percentile double, expected_citations_per_year double, field_citation_rate double, is_clinical string,"
    "is_research_article string, human double, animal double, molecular_cellular double, apt double"
)
_TEXT = "struct<_VALUE:string>"
PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    "Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_Label:string,_NlmCategory:string,_VALUE:string>>>,"
    "Journal:struct<Title:string,ISSN:array<struct<_IssnType:string,_VALUE:string>>,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,"
    "ArticleDate:array<struct<Year:string,Month:string,Day:string>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string,Identifier:array<struct<_Source:string,_VALUE:string>>,AffiliationInfo:array<struct<Affiliation:string>>>>>,"
    "PublicationTypeList:struct<PublicationType:array<struct<_UI:string,_VALUE:string>>>,Pagination:struct<MedlinePgn:string,StartPage:string>,Language:array<string>,"
    "GrantList:struct<Grant:array<struct<Agency:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_MajorTopicYN:string,_VALUE:string>,QualifierName:array<struct<_MajorTopicYN:string,_VALUE:string>>>>>,"
    "KeywordList:array<struct<Keyword:array<struct<_MajorTopicYN:string,_VALUE:string>>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>,History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>>"
)


def parsed(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON text by a schema; text that's no record gives a row of nulls."""
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")


def canonical(df: DataFrame, **columns: Column) -> DataFrame:
    """The schema's columns in order, null where a provider has none."""
    return df.select(*((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPER.fields))


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _kept(c: Column) -> Column:
    """A list without nulls and empty strings."""
    return F.filter(_list(c), lambda x: F.coalesce(x, F.lit("")) != "")


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_kept(c)))


def _authors(found: Column, name, orcid, affiliation) -> Column:
    """Named authors with their place in the provider's list."""
    rows = F.transform(_list(found), lambda a, i: F.struct(name(a).alias("name"), orcid(a).alias("orcid"), affiliation(a).alias("affiliation"), (i + 1).cast("int").alias("position")))
    return F.filter(rows, lambda a: F.coalesce(a["name"], F.lit("")) != "")


def openalex(df: DataFrame, tier: str = "dispersed", focus: str | None = None) -> DataFrame:
    journal = "primary_location.source"
    affiliations = lambda a: _kept(F.transform(_list(a["institutions"]), lambda i: i["display_name"]))
    authors = _authors(F.col("authorships"), lambda a: a["author"]["display_name"], lambda a: _some(F.replace(a["author"]["orcid"], F.lit("https://orcid.org/"), F.lit(""))), lambda a: F.get(affiliations(a), 0))
    named = F.filter(_list(F.col("authorships")), lambda a: F.coalesce(a["author"]["display_name"], F.lit("")) != "")
    countries = F.flatten(F.transform(named, lambda a: F.concat(F.transform(_list(a["institutions"]), lambda i: i["country_code"]), _list(a["countries"]))))
    keywords = _kept(F.transform("keywords", lambda k: k["display_name"]))
    concepts = _kept(F.transform(F.slice("concepts", 1, 8), lambda k: k["display_name"]))
    last = lambda c: _some(F.substring_index(c, "/", -1))
    mesh = F.filter(_list(F.col("mesh")), lambda m: F.coalesce(m["descriptor_name"], F.lit("")) != "")
    return canonical(
        df.withColumn("_a", authors),
        source=F.lit("openalex"), source_id=F.coalesce(last(F.col("id")), F.lit("")), doi=text.normalize_doi(F.col("doi")), pmid=last(F.col("ids.pmid")), title=F.trim(F.coalesce("display_name", F.lit(""))),
        abstract=F.coalesce(text.linear_text(F.col("abstract_inverted_index")), F.lit("")), journal_raw=F.trim(F.coalesce(f"{journal}.display_name", F.lit(""))), issn_l=F.col(f"{journal}.issn_l"),
        publisher=F.col(f"{journal}.host_organization_name"), year=F.col("publication_year"), pub_date=F.col("publication_date"), volume=F.col("biblio.volume"), issue=F.col("biblio.issue"),
        pages=_some(F.concat_ws("-", _some(F.col("biblio.first_page")), _some(F.col("biblio.last_page")))), doc_type_raw=F.col("type"), language=F.col("language"), is_oa=F.col("open_access.is_oa"),
        n_authors=F.size("_a"), authors=F.col("_a"), affiliations_raw=_set(F.flatten(F.transform(named, affiliations))), countries=_set(countries),
        funders=_set(F.transform("funders", lambda f: F.coalesce(_some(f["display_name"]), f["funder_display_name"]))), mesh_terms=F.transform(mesh, lambda m: m["descriptor_name"]),
        mesh_major_terms=F.transform(F.filter(mesh, lambda m: F.coalesce(m["is_major_topic"], F.lit(False))), lambda m: m["descriptor_name"]), topic_focus=F.lit(focus),
        keywords=F.when(F.size(keywords) > 0, keywords).otherwise(concepts), references_count=F.col("referenced_works_count"), cited_by_count=F.col("cited_by_count"), citation_source=F.lit("openalex"),
        url=F.col("id"), retracted=F.coalesce("is_retracted", F.lit(False)), venue_tier=F.lit(tier),
    )


def europepmc(df: DataFrame) -> DataFrame:
    listed = lambda a: F.concat(_kept(F.transform(_list(a["authorAffiliationDetailsList"]["authorAffiliation"]), lambda x: x["affiliation"])), _kept(F.array(a["affiliation"])))
    name = lambda a: F.coalesce(_some(a["fullName"]), _some(a["collectiveName"]), _some(F.concat_ws(" ", _some(a["firstName"]), _some(a["lastName"]))))
    authors = _authors(F.col("authorList.author"), name, lambda a: F.when(a["authorId"]["type"] == "ORCID", a["authorId"]["value"]), lambda a: F.get(listed(a), 0))
    named = F.filter(_list(F.col("authorList.author")), lambda a: name(a).isNotNull())
    kinds = F.transform(_list(F.col("pubTypeList.pubType")), F.lower)
    title = F.regexp_replace(F.trim(F.coalesce("title", F.lit(""))), "\\.+$", "")
    major = _kept(F.transform(F.filter(_list(F.col("meshHeadingList.meshHeading")), lambda m: m["majorTopic_YN"] == "Y"), lambda m: m["descriptorName"]))
    whole = F.when(F.col("pubYear").rlike("^\\s*\\d+\\s*$"), F.trim("pubYear").cast("int"))
    return canonical(
        df.withColumns({"_a": authors, "_kinds": kinds, "_title": title, "_major": major}),
        source=F.lit("europepmc"), source_id=F.coalesce("id", F.lit("")), doi=text.normalize_doi(F.col("doi")), pmid=_some(F.col("pmid")), title=F.col("_title"),
        abstract=F.trim(F.regexp_replace(F.coalesce("abstractText", F.lit("")), "<[^>]+>", " ")), journal_raw=F.trim(F.coalesce("journalInfo.journal.title", F.lit(""))),
        issn_l=F.coalesce(_some(F.col("journalInfo.journal.issn")), F.col("journalInfo.journal.essn")), year=whole, pub_date=F.coalesce(_some(F.col("firstPublicationDate")), F.col("electronicPublicationDate")),
        volume=F.col("journalInfo.volume"), issue=F.col("journalInfo.issue"), pages=F.col("pageInfo"), doc_type_raw=F.array_join("_kinds", "; "), language=F.col("language"),
        is_oa=F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False)), n_authors=F.size("_a"), authors=F.col("_a"), affiliations_raw=_set(F.flatten(F.transform(named, listed))), mesh_major_terms=F.col("_major"),
        topic_focus=text.topic_focus(F.col("_title"), F.col("_major")), keywords=_kept(F.col("keywordList.keyword")), cited_by_count=F.col("citedByCount"), citation_source=F.lit("europepmc"),
        url=F.when((_some(F.col("source")).isNotNull()) & _some(F.col("id")).isNotNull(), F.concat(F.lit("https://europepmc.org/article/"), "source", F.lit("/"), "id")),
        retracted=F.exists("_kinds", lambda p: p.contains("retract")),
    )


def scopus(df: DataFrame) -> DataFrame:
    q = lambda c: F.col(f"`{c}`")
    authors = _authors(F.col("author"), lambda a: F.coalesce(_some(a["authname"]), a["ce:indexed-name"]), lambda a: a["orcid"], lambda a: F.lit(None).cast("string"))
    date = F.coalesce(q("prism:coverDate"), F.lit(""))
    total = F.coalesce(F.col("author-count").getField("@total").cast("int"), F.lit(0))
    return canonical(
        df.withColumn("_a", authors),
        source=F.lit("scopus"), source_id=F.replace(F.coalesce(q("dc:identifier"), F.lit("")), F.lit("SCOPUS_ID:"), F.lit("")), doi=text.normalize_doi(q("prism:doi")), pmid=q("pubmed-id"),
        title=F.trim(F.coalesce(q("dc:title"), F.lit(""))), abstract=F.trim(F.coalesce(q("dc:description"), F.lit(""))), journal_raw=F.trim(F.coalesce(q("prism:publicationName"), F.lit(""))),
        issn_l=F.coalesce(_some(q("prism:issn")), q("prism:eIssn")), year=F.when(date.rlike("^\\d{4}"), F.substring(date, 1, 4).cast("int")), pub_date=_some(date), volume=q("prism:volume"),
        issue=q("prism:issueIdentifier"), pages=q("prism:pageRange"), doc_type_raw=F.col("subtypeDescription"), is_oa=F.coalesce("openaccessFlag", F.lit(False)),
        n_authors=F.when(F.size("_a") > 0, F.size("_a")).otherwise(total), authors=F.col("_a"), affiliations_raw=_kept(F.transform("affiliation", lambda a: a["affilname"])),
        countries=_set(F.transform("affiliation", lambda a: a["affiliation-country"])), keywords=_kept(F.transform(F.split(F.coalesce("authkeywords", F.lit("")), "[|]"), lambda t: F.trim(t))),
        cited_by_count=F.coalesce(q("citedby-count").cast("int"), F.lit(0)), citation_source=F.lit("scopus"), url=F.get(F.filter("link", lambda x: x["@ref"] == "scopus"), 0).getField("@href"), retracted=F.lit(False),
    )


def wos(df: DataFrame) -> DataFrame:
    """Abstracts aren't part of this provider's answer, so they're empty. A title may come as an object with `value`."""
    authors = _authors(F.col("names.authors"), lambda a: F.coalesce(_some(a["displayName"]), a["wosStandard"]), lambda a: a["researcherId"], lambda a: F.lit(None).cast("string"))
    title = F.when(F.col("title").startswith("{"), F.get_json_object("title", "$.value")).otherwise(F.col("title"))
    return canonical(
        df.withColumn("_a", authors),
        source=F.lit("wos"), source_id=F.coalesce("uid", F.lit("")), doi=text.normalize_doi(F.col("identifiers.doi")), pmid=_some(F.replace("identifiers.pmid", F.lit("MEDLINE:"), F.lit(""))),
        title=F.coalesce(title, F.lit("")), abstract=F.lit(""), journal_raw=F.coalesce("source.sourceTitle", F.lit("")), issn_l=F.coalesce(_some(F.col("identifiers.issn")), F.col("identifiers.eissn")),
        year=F.when(F.col("source.publishYear").rlike("^\\d+$"), F.col("source.publishYear").cast("int")), pub_date=F.col("source.publishMonth"), volume=F.col("source.volume"), issue=F.col("source.issue"),
        pages=F.col("source.pages.range"), doc_type_raw=F.array_join("types", "; "), n_authors=F.size("_a"), authors=F.col("_a"), keywords=_list(F.col("keywords.authorKeywords")),
        cited_by_count=F.get(F.filter("citations", lambda c: c["db"] == "WOS"), 0)["count"], citation_source=F.lit("wos"), url=F.col("links.record"), retracted=F.lit(False),
    )


def read_pubmed_xml(spark, path: str) -> DataFrame:
    """Article elements of XML files, split by the engine; inline markup inside titles and abstracts is kept as text by plain_markup()."""
    return spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED).load(path)


def plain_markup(xml: Column) -> Column:
    """XML text without the inline elements that providers set in titles and abstracts."""
    return F.regexp_replace(xml, "</?(?:i|b|u|sub|sup|em|strong)>", "")


def pubmed_xml_text(rows: DataFrame, column: str = "value") -> DataFrame:
    """Cached payloads, one document of many articles a row, as article rows."""
    articles = F.regexp_extract_all(plain_markup(F.col(column)), F.lit("(?s)(<PubmedArticle[ >].*?</PubmedArticle>)"), 1)
    return rows.select(F.explode(articles).alias("x")).select(F.from_xml("x", PUBMED).alias("r")).select("r.*")


def pubmed(df: DataFrame) -> DataFrame:
    art, cit = "MedlineCitation.Article", "MedlineCitation"
    squeeze = lambda c: _some(text.squeeze(c))
    values = lambda c: F.transform(_list(c), lambda x: x["_VALUE"])
    sections = F.transform(_list(F.col(f"{art}.Abstract.AbstractText")), lambda s: F.struct(F.coalesce(_some(s["_Label"]), _some(s["_NlmCategory"])).alias("label"), text.squeeze(s["_VALUE"]).alias("body")))
    of = lambda c, kind, value: F.element_at(F.filter(_list(c), lambda x: x[kind] == value), -1)["_VALUE"]
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    doi = F.coalesce(text.normalize_doi(F.try_element_at(F.transform(F.filter(_list(ids), lambda x: x["_IdType"] == "doi"), lambda x: x["_VALUE"]), F.lit(-1))), text.normalize_doi(F.try_element_at(F.transform(F.filter(_list(F.col(f"{art}.ELocationID")), lambda x: x["_EIdType"] == "doi"), lambda x: x["_VALUE"]), F.lit(-1))))
    name = lambda a: F.coalesce(squeeze(a["CollectiveName"]), _some(F.concat_ws(" ", _some(a["ForeName"]), _some(a["LastName"]))))
    orcid = lambda a: text.orcid(F.get(F.filter(_list(a["Identifier"]), lambda x: x["_Source"] == "ORCID"), 0)["_VALUE"])
    places = lambda a: _kept(F.transform(_list(a["AffiliationInfo"]), lambda x: text.squeeze(x["Affiliation"])))
    authors = _authors(F.col(f"{art}.AuthorList.Author"), name, orcid, lambda a: F.get(places(a), 0))
    electronic, printed = F.get(F.col(f"{art}.ArticleDate"), 0), F.col(f"{art}.Journal.JournalIssue.PubDate")
    entered = F.get(F.filter(_list(F.col("PubmedData.History.PubMedPubDate")), lambda x: x["_PubStatus"] == "pubmed"), 0)
    none = F.lit(None).cast("string")
    date = F.coalesce(
        text.publication_date(electronic["Year"], electronic["Month"], electronic["Day"], none), text.publication_date(printed["Year"], printed["Month"], printed["Day"], printed["MedlineDate"]),
        text.publication_date(entered["Year"], entered["Month"], entered["Day"], none),
    )
    heads = F.filter(_list(F.col(f"{cit}.MeshHeadingList.MeshHeading")), lambda m: m["DescriptorName"]["_VALUE"].isNotNull())
    major = F.filter(heads, lambda m: (m["DescriptorName"]["_MajorTopicYN"] == "Y") | F.exists(_list(m["QualifierName"]), lambda x: F.coalesce(x["_MajorTopicYN"] == "Y", F.lit(False))))
    names = lambda c: F.transform(c, lambda m: text.squeeze(m["DescriptorName"]["_VALUE"]))
    issns = _list(F.col(f"{art}.Journal.ISSN"))
    kinds = values(F.col(f"{art}.PublicationTypeList.PublicationType"))
    df = df.where(F.col(art).isNotNull()).withColumns({"_a": authors, "_title": F.coalesce(squeeze(F.col(f"{art}.ArticleTitle")), F.lit("")), "_major": names(major), "_kinds": kinds, "_date": date, "_pmid": F.col(f"{cit}.PMID._VALUE")})
    return canonical(
        df,
        source=F.lit("pubmed"), source_id=F.coalesce("_pmid", F.lit("")), doi=doi, pmid=F.coalesce("_pmid", F.lit("")), title=F.col("_title"), abstract=text.labelled_abstract(sections),
        journal_raw=F.coalesce(squeeze(F.col(f"{art}.Journal.Title")), F.lit("")),
        issn_l=F.coalesce(F.get(F.filter(issns, lambda x: x["_IssnType"] == "Print"), 0)["_VALUE"], F.try_element_at(issns, F.lit(-1))["_VALUE"]), year=F.substring("_date", 1, 4).cast("int"), pub_date=F.col("_date"),
        volume=F.col(f"{art}.Journal.JournalIssue.Volume"), issue=F.col(f"{art}.Journal.JournalIssue.Issue"), pages=F.coalesce(_some(F.col(f"{art}.Pagination.MedlinePgn")), F.col(f"{art}.Pagination.StartPage")),
        doc_type_raw=F.array_join("_kinds", "; "), language=F.get(F.col(f"{art}.Language"), 0), n_authors=F.size("_a"), authors=F.col("_a"),
        affiliations_raw=_set(F.flatten(F.transform(F.filter(_list(F.col(f"{art}.AuthorList.Author")), lambda a: name(a).isNotNull()), places))),
        funders=_set(F.transform(_list(F.col(f"{art}.GrantList.Grant")), lambda g: text.squeeze(g["Agency"]))), mesh_terms=names(heads), mesh_major_terms=F.col("_major"),
        topic_focus=text.topic_focus(F.col("_title"), F.col("_major")), keywords=F.flatten(F.transform(_list(F.col(f"{cit}.KeywordList")), lambda k: values(k["Keyword"]))),
        retracted=F.exists("_kinds", lambda p: p.contains("Retract")), url=F.when(F.coalesce("_pmid", F.lit("")) != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "_pmid", F.lit("/"))),
    )


def reparsed(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Cached payloads mapped anew, one record a PMID: the fullest, then the first by its text."""
    from pyspark.sql import Window

    rows = pubmed(pubmed_xml_text(payloads.where(F.col(column).contains("<PubmedArticle")), column))
    first = Window.partitionBy("pmid").orderBy(F.desc(F.length("abstract")), "title", "doi")
    return rows.where("pmid <> ''").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
