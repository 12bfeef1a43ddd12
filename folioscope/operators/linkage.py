"""Entity resolution: identifiers first, then fuzzy titles inside blocks, then field-wise survivorship.

Records need a unique `row_id`. Pass 1 ties records that share a DOI, a PMID, or (without either) a signature. Pass 2
compares titles inside blocks of year and first telling word, and merges what a second signal confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import similarity, text
from folioscope.operators import candidates, graph
from folioscope.operators.candidates import block_pairs

__all__ = ["block_pairs", "candidate_pairs", "corroborated", "deduplicate", "fuzzy_clusters", "fuzzy_matches", "identifier_clusters", "scored_pairs", "survivors"]

# Thresholds and the order in which providers are trusted, field by field.
AUTO_ACCEPT, REVIEW_FROM, VENUE_AGREES, LEAST_TITLE, LARGEST_BLOCK = 90.0, 80.0, 88.0, 15, 400
FIELD_PRIORITY = {
    "abstract": ("pubmed", "openalex"), "mesh_terms": ("pubmed", "openalex"), "mesh_major_terms": ("pubmed", "openalex"), "doc_type_raw": ("pubmed", "openalex"), "funders": ("pubmed", "openalex"),
    "cited_by_count": ("openalex", "pubmed"), "authors": ("openalex", "pubmed"), "affiliations_raw": ("openalex", "pubmed"), "countries": ("openalex", "pubmed"), "is_oa": ("openalex", "pubmed"),
    "publisher": ("openalex", "pubmed"), "issn_l": ("openalex", "pubmed"), "references_count": ("openalex", "pubmed"),
}
FILLED = ("doi", "pmid", "title", "journal_raw", "year", "pub_date", "volume", "issue", "pages", "language", "url", "keywords")


def keyed(records: DataFrame) -> DataFrame:
    """With the record's identifiers as columns: id_doi, id_pmid, id_sig (only without the others) and block."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    doi, pmid = some("doi"), some("pmid")
    sig = text.signature(F.col("title"), F.col("year"), F.col("journal_raw"))
    return records.withColumns({"id_doi": doi, "id_pmid": pmid, "id_sig": F.when(doi.isNull() & pmid.isNull(), sig), "block": text.block_key(F.col("title"), F.col("year"))})


def identifier_edges(keyed_records: DataFrame) -> DataFrame:
    """(a, b, by): each record tied to the smallest that has the same identifier; a group of n gives n - 1 edges."""
    ids = keyed_records.select("row_id", F.explode(F.array(*(F.struct(F.lit(k).alias("by"), F.col(f"id_{k}").alias("value")) for k in ("doi", "pmid", "sig")))).alias("x")).select("row_id", "x.*").where("value is not null")
    # signatures of whole titles are made once
    ids = graph.checkpointed(ids)
    first = ids.groupBy("by", "value").agg(F.min("row_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # an identifier that very many records share is dealt over many tasks
    return graph.spread_join(ids, first, ["by", "value"], 2 * keyed_records.count()).where("row_id <> a").select("a", F.col("row_id").alias("b"), "by")


def identifier_clusters(records: DataFrame) -> DataFrame:
    """(row_id, cluster): the smallest row_id that shared identifiers reach, over any chain of them."""
    own = keyed(records)
    found = graph.components(identifier_edges(own).select("a", "b"))
    return own.select("row_id").join(found, F.col("row_id") == F.col("node"), "left").select("row_id", F.coalesce("root", "row_id").alias("cluster"))


def _some(field: str, kind: str) -> str:
    """SQL: the field isn't missing."""
    return f"size(`{field}`) > 0" if kind.startswith(("array", "map")) else f"`{field}` IS NOT NULL" + (f" AND `{field}` <> ''" if kind == "string" else "")


def survivors(records: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One record for each cluster: every field from the most trusted provider that has it, then the smallest row_id.

    Null, the empty string and an empty list count as missing; 0 and false don't. Flags of retraction are or-ed, the
    best tier and focus win, the most authors count, and providers are listed once each, in order.
    """
    kinds = dict(records.dtypes)
    out: list[Column] = []

    def best(field: str, order: tuple[str, ...]) -> Column:
        rank = "CASE source " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(order)) + f" ELSE {len(order)} END" if order else "0"
        return F.expr(f"min_by(`{field}`, CASE WHEN {_some(field, kinds[field])} THEN struct({rank} AS rank, row_id) END)").alias(field)

    special = {"row_id", "source", "source_id", "retracted", "venue_tier", "topic_focus", "n_authors", cluster}
    for field in records.columns:
        if field not in special:
            out.append(best(field, FIELD_PRIORITY.get(field, ())))
    if "source" in kinds:
        out.append(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("_source"))
        if "source_id" in kinds:
            pairs = F.array_sort(F.collect_set(F.when(F.col("source").isNotNull() & F.col("source_id").isNotNull(), F.struct("source", "source_id"))))
            # the last of a provider's identifiers stands, in order
            last = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k + 1)["source"] != x["source"], F.lit(True)))
            out.append(F.map_from_entries(last).alias("source_ids"))
    if "retracted" in kinds:
        out.append(F.coalesce(F.bool_or("retracted"), F.lit(False)).alias("retracted"))
    for field, order in (("venue_tier", ("core_a", "adjacent_b", "dispersed")), ("topic_focus", ("focused", "peripheral"))):
        if field in kinds:
            out.append(F.min_by(field, F.when(F.col(field).isNotNull(), F.coalesce(*(F.when(F.col(field) == s, F.lit(k)) for k, s in enumerate(order)), F.lit(len(order))))).alias(field))
    if "n_authors" in kinds:
        out.append(F.coalesce(F.max("n_authors"), F.lit(0)).alias("n_authors"))
    merged = records.groupBy(cluster).agg(*out, F.count(F.lit(1)).alias("n_merged"), F.min("row_id").alias("row_id"))
    return merged.withColumnRenamed("_source", "source")


def comparable(records: DataFrame) -> DataFrame:
    """What pass 2 needs of each record."""
    # the block is cut from the normalised title, which is made once
    own = keyed(records).drop("block").withColumn("norm", text.title_norm(F.col("title"))).withColumn("block", text.block_key_of(F.col("norm"), F.col("year")))
    return own.select("row_id", "block", "id_doi", "id_pmid", F.col("norm").alias("title"), F.nullif("issn_l", F.lit("")).alias("issn"), text.title_norm(F.col("journal_raw")).alias("venue"), text.first_author_key(F.col("authors")).alias("author"))


def scored_pairs(own: DataFrame, least: float, agree: Column | None = None) -> DataFrame:
    """(block, l_, r_, score): pairs of records of a block whose titles' score is `least` or more and for which `agree` holds.

    Words are sorted once a record, and each different title of a block is looked for once, in an index of its rarest grams.
    """
    first = candidates.first_of_text(own, similarity.token_sorted(F.col("title")))
    like = candidates.like_pairs(first.where("row_id = first").select("row_id", "block", "x"), least)
    pairs = candidates.of_rows(own, like, first.select("row_id", "first"))
    return pairs if agree is None else pairs.where(agree)


def candidate_pairs(records: DataFrame, least: float = REVIEW_FROM, largest_block: int | None = None) -> DataFrame:
    """(block, l_, r_, score): pairs of a block whose titles score `least` or more and whose identifiers don't conflict.

    All blocks are compared. Only for the reference's result, LARGEST_BLOCK as `largest_block` leaves larger blocks out.
    Titles under 15 characters aren't compared.
    """
    own = graph.checkpointed(comparable(records))
    if largest_block is not None:
        sizes = own.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= largest_block)).select("block")
        own = own.join(sizes, "block", "left_semi")
    differ = lambda c: F.coalesce(F.col(f"l_{c}") != F.col(f"r_{c}"), F.lit(False))
    return scored_pairs(own.where(F.length("title") >= LEAST_TITLE), least, ~differ("id_doi") & ~differ("id_pmid"))


def corroborated(pairs: DataFrame) -> DataFrame:
    """With corroborated: the first pair of signals that both sides have decides (ISSN, venue, first author); without any, true."""
    both = lambda c: (F.coalesce(F.col(f"l_{c}"), F.lit("")) != "") & (F.coalesce(F.col(f"r_{c}"), F.lit("")) != "")
    same = lambda c: F.col(f"l_{c}") == F.col(f"r_{c}")
    venue = similarity.token_sort_ratio(F.col("l_venue"), F.col("r_venue")) >= VENUE_AGREES
    return pairs.withColumn("corroborated", F.when(both("issn"), same("issn")).when(both("venue"), venue).when(both("author"), same("author")).otherwise(True))


def fuzzy_matches(records: DataFrame, largest_block: int | None = None, least: float = REVIEW_FROM) -> DataFrame:
    """(block, a, b, score, corroborated, verdict): merge from 90 with a second signal, else review. Pairs from `least` on."""
    pairs = corroborated(candidate_pairs(records, least, largest_block))
    verdict = F.when((F.col("score") >= AUTO_ACCEPT) & F.col("corroborated"), "merge").otherwise("review")
    return pairs.select("block", F.col("l_row_id").alias("a"), F.col("r_row_id").alias("b"), "score", "corroborated", verdict.alias("verdict"), "l_id_doi", "r_id_doi", "l_id_pmid", "r_id_pmid")


def fuzzy_clusters(matches: DataFrame) -> DataFrame:
    """(row_id, cluster) of records that merge, as if one pair after another were merged, in order of a, then b.

    A merge that would put two unlike DOIs or PMIDs into one cluster is refused, though each pair alone was free of
    conflict. Where all records that pairs join have one DOI and one PMID at most, nothing can be refused.
    """
    merges = graph.checkpointed(matches.where("verdict = 'merge'").select("a", "b", "l_id_doi", "r_id_doi", "l_id_pmid", "r_id_pmid"))
    if merges.isEmpty():
        return merges.select(F.col("a").alias("row_id"), F.col("b").alias("cluster"))
    found = graph.checkpointed(graph.components(merges.select("a", "b")))
    ends = [merges.select(F.col(n).alias("node"), F.col(f"{s}_id_doi").alias("doi"), F.col(f"{s}_id_pmid").alias("pmid")) for n, s in (("a", "l"), ("b", "r"))]
    known = ends[0].unionByName(ends[1]).groupBy("node").agg(F.max("doi").alias("doi"), F.max("pmid").alias("pmid"))
    nodes = graph.checkpointed(known.join(found, "node"))
    one = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    agreed = nodes.groupBy("root").agg((one("doi") & one("pmid")).alias("agreed"), F.count(F.lit(1)).alias("n"))
    judged = graph.checkpointed(graph.spread_join(nodes, agreed, "root", nodes.count()))
    free = judged.where("agreed").select(F.col("node").alias("row_id"), F.col("root").alias("cluster"))
    open_ = judged.where("not agreed").select("node", "doi", "pmid")
    if open_.isEmpty():
        return free
    edges = merges.select("a", "b").join(open_.select(F.col("node").alias("a")), "a", "left_semi")
    return free.unionByName(merged_in_order(open_, edges))


#: Pairs of one cluster that one round of merged_in_order() takes up, at most; the next round takes the next.
FIRST_PAIRS = 1_000


def merged_in_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_id, cluster) of `nodes` (node, doi, pmid) as if the pairs `edges` (a, b) were merged one after another, in order.

    In each round clusters that are each other's first pair merge at once, since no earlier pair can touch them; the
    smaller of the two takes in others too, in order, as long as it is their first pair, comes before every other pair of
    those already taken in, and no identifier conflicts. Pairs inside a cluster or in conflict are left out for good, as
    clusters only grow. The first pair of all merges or goes in every round, so rounds end; a cluster's pairs are looked
    at in order, FIRST_PAIRS in a round, never gathered.
    """
    state = graph.checkpointed(nodes.select(F.col("node").alias("row_id"), F.col("node").alias("cluster"), "doi", "pmid"))
    live = graph.checkpointed(edges.select("a", "b").distinct())
    while True:
        side = lambda n, s: state.select(F.col("row_id").alias(n), F.col("cluster").alias(f"{s}c"), F.col("doi").alias(f"{s}doi"), F.col("pmid").alias(f"{s}pmid"))
        met = live.join(side("a", "l"), "a").join(side("b", "r"), "b")
        unlike = lambda c: F.coalesce(F.col(f"l{c}") != F.col(f"r{c}"), F.lit(False))
        live = graph.checkpointed(met.where((F.col("lc") != F.col("rc")) & ~unlike("doi") & ~unlike("pmid")))
        if live.isEmpty():
            named = state.groupBy("cluster").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("n"))
            return graph.spread_join(state.select("row_id", "cluster"), named, "cluster", state.count()).select("row_id", F.col("least").alias("cluster"))
        # each pair of clusters once, by its first pair of records, seen from both sides
        pairs = live.groupBy(F.least("lc", "rc").alias("lo"), F.greatest("lc", "rc").alias("hi")).agg(F.min(F.struct("a", "b", "lc", "ldoi", "lpmid", "rdoi", "rpmid")).alias("o"))
        place = F.struct("o.a", "o.b").alias("place")
        left_low = F.col("o.lc") == F.col("lo")
        whose = lambda c, low: F.when(left_low == F.lit(low), F.col(f"o.l{c}")).otherwise(F.col(f"o.r{c}")).alias(f"its_{c}")
        seen = [pairs.select(F.col(own).alias("own"), F.col(other).alias("other"), place, whose("doi", low), whose("pmid", low)) for own, other, low in (("lo", "hi", False), ("hi", "lo", True))]
        seen = graph.checkpointed(seen[0].unionByName(seen[1]))
        # a cluster's first pair, whose that is, and its next pair with another
        two = seen.withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("place"))).where("k <= 2")
        firsts = two.groupBy("own").agg(F.min_by("other", "k").alias("to"), F.min("place").alias("first"), F.max(F.when(F.col("k") == 2, F.col("place"))).alias("next"))
        firsts = graph.checkpointed(firsts)
        owners = firsts.alias("x").join(firsts.alias("y"), (F.col("x.to") == F.col("y.own")) & (F.col("y.to") == F.col("x.own")) & (F.col("x.own") < F.col("y.own"))).select("x.own")
        listed = seen.join(owners, "own", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("place"))).where(F.col("k") <= FIRST_PAIRS)
        listed = listed.join(firsts.select(F.col("own").alias("other"), "to", "next"), "other")
        listed = listed.join(state.where("row_id = cluster").select(F.col("cluster").alias("own"), "doi", "pmid"), "own")
        so_far = Window.partitionBy("own").orderBy("k")
        before = so_far.rowsBetween(Window.unboundedPreceding, -1)
        held = lambda c: F.coalesce(F.col(c), F.first(f"its_{c}", ignorenulls=True).over(before))
        fits = (F.col("to") == F.col("own")) & F.coalesce(F.col("place") < F.min("next").over(before), F.lit(True))
        for c in ("doi", "pmid"):
            fits = fits & F.coalesce(held(c) == F.col(f"its_{c}"), F.lit(True))
        taken = listed.withColumn("fits", fits).withColumn("taken", F.every("fits").over(so_far)).where("taken")
        taken = graph.checkpointed(taken.select("own", "other", "its_doi", "its_pmid", "k"))
        gained = taken.groupBy("own").agg(F.max("its_doi").alias("new_doi"), F.max("its_pmid").alias("new_pmid"))
        moved = state.join(taken.select(F.col("other").alias("cluster"), "own"), "cluster", "left").withColumn("cluster", F.coalesce("own", "cluster")).drop("own")
        grown = moved.join(gained.withColumnRenamed("own", "cluster"), "cluster", "left")
        own_ids = state.where("row_id = cluster").select("cluster", F.col("doi").alias("root_doi"), F.col("pmid").alias("root_pmid"))
        grown = grown.join(own_ids, "cluster")
        state = graph.checkpointed(grown.select("row_id", "cluster", F.coalesce("root_doi", "new_doi").alias("doi"), F.coalesce("root_pmid", "new_pmid").alias("pmid")))
        live = live.select("a", "b")


def deduplicate(records: DataFrame, largest_block: int | None = None, least: float = REVIEW_FROM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, review, report): one record a work with record_id, pairs for people to judge, and one row of counts.

    Pairs are looked for from `least` on. Only those from AUTO_ACCEPT on merge, so up to that works are the same; review and
    its count have pairs from `least` on.
    """
    own = keyed(records)
    edges = graph.checkpointed(identifier_edges(own))
    found = graph.components(edges.select("a", "b"))
    tied = records.join(found, F.col("row_id") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "row_id")).drop("node", "root")
    first = graph.checkpointed(survivors(tied).drop("cluster"))
    plain = first.select([c for c in first.columns if c not in ("n_merged", "source_ids")])
    matches = graph.checkpointed(fuzzy_matches(plain, largest_block, least))
    fuzzy = fuzzy_clusters(matches)
    again = plain.join(fuzzy, "row_id", "left").withColumn("cluster", F.coalesce("cluster", "row_id"))
    ids = tied.select(F.col("cluster").alias("first"), "source", "source_id").where("source is not null and source_id is not null")
    named = ids.join(again.select(F.col("row_id").alias("first"), "cluster"), "first").groupBy("cluster").agg(F.sort_array(F.collect_set(F.struct("source", "source_id"))).alias("pairs"))
    last = F.filter("pairs", lambda x, k: F.coalesce(F.get("pairs", k + 1)["source"] != x["source"], F.lit(True)))
    providers = named.select("cluster", F.map_from_entries(last).alias("source_ids"), F.array_join(F.array_distinct(F.transform("pairs", lambda p: p["source"])), "+").alias("providers"))
    works = survivors(again.drop("source_id")).join(providers, "cluster", "left").withColumn("source", F.coalesce("providers", "source")).drop("providers", "cluster")
    works = works.withColumn("record_id", text.record_id(F.col("doi"), F.col("pmid"), text.signature(F.col("title"), F.col("year"), F.col("journal_raw"))))
    works = graph.checkpointed(works)
    review = matches.where("verdict = 'review'").select("block", "a", "b", "score", F.when(F.col("score") >= AUTO_ACCEPT, "title_match_without_corroboration").otherwise("review_band").alias("reason"))
    counts = works.agg(F.count(F.lit(1)).alias("output_records"))
    of = lambda k: edges.where(F.col("by") == k).agg(F.count(F.lit(1)).alias(f"{k}_links"))
    report = (
        records.agg(F.count(F.lit(1)).alias("input_records")).join(counts).join(of("doi")).join(of("pmid")).join(of("sig"))
        .join(first.agg(F.count(F.lit(1)).alias("after_identifiers"))).join(review.agg(F.count(F.lit(1)).alias("review_pairs")))
    )
    report = report.withColumns({"duplicates_removed": F.col("input_records") - F.col("output_records"), "fuzzy_merges": F.col("after_identifiers") - F.col("output_records")})
    return works, review, report


def blocks(records: DataFrame, largest_block: int | None = None) -> DataFrame:
    """(block, n, compared): the size of each block and whether pass 2 compares it."""
    sized = keyed(records).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return sized.withColumn("compared", (F.col("n") > 1) & (F.lit(largest_block is None) | (F.col("n") <= F.lit(largest_block))))
