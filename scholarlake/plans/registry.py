"""Every operator as a query over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import eligible, percent_rank_by
from ..functions.storage import scratch, store
from ..operators import authors as au
from ..operators import export, incremental, network, refresh, resolution, serving
from ..operators import publications as pu
from ..operators import temporal as te
from ..sources import adapters, documents
from ..sources.versioned import KeyedTable, SortedTable
from ..streaming import upsert

AS_OF, HORIZON, SEED = 2025, 2025, 7
NOW = "2025-01-15 00:00:00"
TODAY = datetime(2025, 1, 15)


class Frames:
    """The chain of views over one set of tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def store(self, df: DataFrame) -> DataFrame:
        """A view that several others read, written once: plans stay linear and restart at files."""
        return store(df)

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.dir, name)

    @cached_property
    def raw_authors(self):
        return adapters.raw_authors(self.spark, self.dir)

    @cached_property
    def raw_pubs(self):
        return adapters.raw_publications(self.spark, self.dir)

    @cached_property
    def authors(self):
        return documents.profiles_of(self.author_docs.withColumnRenamed("profile", "d"))

    @cached_property
    def author_docs(self):
        """The author documents parsed, written once: a JSON text of an author's whole list would be built and parsed for every reader of its profile."""
        return self.store(documents.author_documents(self.raw_authors))

    @cached_property
    def pubs(self):
        return self.store(documents.decode_publications(self.raw_pubs))

    @cached_property
    def listed(self):
        return documents.listings_of(self.author_docs.withColumnRenamed("listing", "d"))

    @cached_property
    def edges(self):
        return documents.coauthor_network(adapters.raw_network_authors(self.spark, self.dir))

    @cached_property
    def current(self):
        return self.store(pu.publication_current(self.pubs, AS_OF))

    @cached_property
    def cited(self):
        """A row per publication with its cited years: what the authors' states are made of."""
        return pu.cited_years(self.pubs, HORIZON)

    @cached_property
    def series(self):
        """A row per publication, with its years as an array: what the timeline is made of."""
        return self.store(pu.citation_series(self.pubs, HORIZON))

    @cached_property
    def timeline(self):
        return pu.timeline_of(self.series)

    @cached_property
    def timeline_pct(self):
        return pu.timeline_percentiles(self.timeline)

    @cached_property
    def author_rows(self):
        return self.store(au.author_rows(self.authors, self.listed, self.current, AS_OF))

    @cached_property
    def stats(self):
        return au.author_current(self.author_rows)

    @cached_property
    def cohort(self):
        """What the score needs of AUT-4: one percentile of eight."""
        rows = self.author_rows.select("scholar_id", au.COHORT, au.COUNTS[1])
        return percent_rank_by(rows, [au.COHORT], {f"{au.COUNTS[1]}_percentile": au.COUNTS[1]})

    @cached_property
    def ranked(self):
        return au.ranked_publications(self.current, self.cohort)

    @cached_property
    def inputs(self):
        return self.store(au.pip_inputs(self.ranked, au.productivity_curve(self.cohort)))

    @cached_property
    def auc(self):
        return au.pip_auc(self.inputs)

    @cached_property
    def scores(self):
        return self.store(au.auc_percentile(self.auc, self.cohort))

    @cached_property
    def state(self):
        light, heavy = te.publication_states_apart(self.listed, self.cited, self.heavy)
        return light if heavy is None else light.unionByName(heavy)

    @cached_property
    def heavy(self):
        return te.heavy_authors(self.listed)

    @cached_property
    def first_year(self):
        return au.first_cited_year(self.listed, self.current)

    @cached_property
    def metrics(self):
        return self.store(te.metrics_of_listings(self.listed, self.cited, self.first_year, self.heavy))

    @cached_property
    def temporal(self):
        return te.author_temporal(self.metrics)

    @cached_property
    def registered(self):
        return self.table("supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("scholar_id"))

    @cached_property
    def counted(self):
        return network.unregistered_coauthors(self.edges, self.registered)

    @cached_property
    def names(self):
        pubs, authors = adapters.resolution_inputs(self.spark, self.dir)
        return resolution.split_authors(pubs), authors

    @cached_property
    def resolved(self):
        return resolution.resolve_exact(*self.names)

    @cached_property
    def served(self):
        return serving.author_publications_served(self.pubs, self.inputs)

    @cached_property
    def with_scores(self):
        return serving.authors_with_scores(self.stats, self.scores)

    @cached_property
    def by_year(self):
        return serving.publication_by_year(self.timeline_pct, AS_OF)

    @cached_property
    def modified(self):
        return serving.last_modified(self.authors, self.pubs)

    @cached_property
    def log(self):
        return adapters.changelog(self.spark, self.dir)

    @cached_property
    def stale(self):
        docs = self.authors.withColumn("document_id", F.col("scholar_id"))
        return refresh.stale_documents(docs, F.to_timestamp(F.lit(NOW)), 90, 500, "scholar_id")

    @cached_property
    def pending(self):
        return self.authors.filter(one_in("scholar_id", 3)).select(refresh.task_key(F.col("scholar_id")).alias("task_key"))


def _snapshot(f: Frames) -> DataFrame:
    return documents.latest_snapshot(f.log, "document_id", "timestamp", "event_id").select("document_id", "timestamp", "data")


def _upsert(f: Frames) -> DataFrame:
    early = documents.latest_snapshot(f.log.filter("event_id % 2 = 0").drop("event_id"), "document_id", "timestamp", "data")
    updates = documents.latest_snapshot(f.log.filter("event_id % 2 = 1").drop("event_id"), "document_id", "timestamp", "data")
    return documents.upsert_documents(early, updates).select("document_id", "timestamp", "data")


UPDATE = ["timestamp", "event_id"]


def _updates(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("document_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("data"), "event_id")


def _with_deletes(log: DataFrame) -> DataFrame:
    """Every seventh event deletes its document."""
    return log.withColumn("deleted", F.col("event_id") % 7 == 0)


def _stream(f: Frames) -> DataFrame:
    events = upsert.stream_source(f.spark, f.table("events"), "events.parquet")
    out = scratch(f.spark)
    table = KeyedTable(f.spark, f"{out}/table", order=UPDATE)
    return upsert.drain(_updates(events), table, f"{out}/checkpoint", TODAY).select("document_id", "timestamp", "data")


def _restarted(f: Frames, change=lambda log: log, **options) -> DataFrame:
    """The stream over a log that arrives in three parts: each part is drained by a query of its own over one checkpoint, and a last one finds nothing new."""
    out = scratch(f.spark)
    log = change(f.log)
    stored = None
    for part in (0, 1, 2, None):
        if part is not None:
            log.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(f"{out}/log")
        updates = f.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/log")
        # a table of its own each time: nothing is remembered but what is stored
        table = KeyedTable(f.spark, f"{out}/table", order=UPDATE, **options)
        stored = upsert.drain(updates, table, f"{out}/checkpoint", TODAY)
    return stored.select("document_id", "timestamp", "data")


def _repeated_epoch(f: Frames) -> DataFrame:
    """Each half of the log is merged twice under its epoch, the second time with other data that must not count."""
    table = KeyedTable(f.spark, scratch(f.spark), order=UPDATE)
    for epoch in (0, 1):
        half = f.log.filter(F.col("event_id") % 2 == epoch)
        table.merge(half, TODAY, "log", epoch)
        table.merge(half.withColumns({"data": F.lit("again"), "timestamp": F.col("timestamp") + F.expr("INTERVAL 9 DAYS")}), TODAY, "log", epoch)
    return table.read().select("document_id", "timestamp", "data")


def _snapshot_with_deletes(f: Frames) -> DataFrame:
    return documents.latest_snapshot(_with_deletes(f.log), "document_id", *UPDATE, deleted="deleted").select("document_id", "timestamp", "data")


def _upsert_with_deletes(f: Frames) -> DataFrame:
    """Even events stored, odd ones merged in; tombstones of either half count, and later updates revive."""
    log = _with_deletes(f.log).drop("event_id")
    early, updates = (documents.latest_snapshot(log.filter(F.col("timestamp") < day) if day else log, "document_id", "timestamp", "deleted", "data") for day in ("2024-01-15", None))
    both = documents.upsert_documents(early, updates)
    return documents.latest_snapshot(both, deleted="deleted").select("document_id", "timestamp", "data")


def _csv_all(f: Frames) -> DataFrame:
    out = export.CsvExport(f.spark, scratch(f.spark))
    out.refresh(lambda: f.with_scores, TODAY)
    return out.read()


def _csv_author(f: Frames) -> DataFrame:
    """Every author's publications as served, in 64 folders by hash of the id."""
    path = scratch(f.spark)
    rows = f.served
    export.export_csv(rows.withColumn("shard", F.pmod(F.xxhash64("scholar_id"), F.lit(64))).repartition("shard"), path, by="shard")
    return f.spark.read.schema(rows.schema).option("header", True).csv(path).select(*rows.columns)


def _gate(stored: export.Gated, build) -> DataFrame:
    """Three requests: the second comes 23 hours after the first and gets what is stored, the third when it is a day old."""
    told = []
    for call, hours in enumerate((0, 23, 24), 1):
        stored.refresh(build, TODAY + timedelta(hours=hours))
        told.append(stored.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(call).alias("call"), "n", F.lit(stored.refreshed_at()).alias("refreshed_at")))
    return told[0].unionByName(told[1]).unionByName(told[2])


def _view(f: Frames) -> DataFrame:
    view = export.View(f.spark, scratch(f.spark), timedelta(days=1))
    view.refresh(lambda: f.metrics, TODAY)
    return view.read()


def _documents(f: Frames) -> SortedTable:
    """The publication documents as a stored table, sorted by id."""
    table = SortedTable(f.spark, scratch(f.spark), "document_id")
    table.replace(f.raw_pubs, TODAY)
    return table


def _lookup_list(f: Frames) -> DataFrame:
    """Author documents by a list of ids, from a stored table sorted by id."""
    table = SortedTable(f.spark, scratch(f.spark), "document_id")
    table.replace(f.raw_authors, TODAY)
    return table.keys([r[0] for r in f.stale.select("scholar_id").collect()]).select("document_id", "timestamp")  # at most 500 ids


def _serving(f: Frames, *names: str) -> serving.ServingViews:
    views = serving.ServingViews(f.spark, scratch(f.spark))
    all_ = {"authors": lambda: f.with_scores, "publications": lambda: f.served, "by_year": lambda: f.by_year, "temporal": lambda: f.temporal}
    views.refresh({n: all_[n] for n in names}, TODAY)
    return views


def _one_publication(f: Frames) -> DataFrame:
    first = f.pubs.filter(F.col("pub_year") <= HORIZON).agg(F.min("author_pub_id")).first()[0]
    return _serving(f, "by_year").publication_years(first)


def _incremental_authors(f: Frames) -> DataFrame:
    """The authors whose cached result is stale have gained citations: their rows and the counts of their cohorts are patched."""
    metrics = (*documents.METRICS, *au.COUNTS)
    table = incremental.RankedTable(f.spark, scratch(f.spark), "scholar_id", [([au.COHORT], {f"{m}_percentile": m for m in metrics})])
    table.build(f.author_rows, TODAY)
    stale = serving.stale_keys(f.modified, f.authors.filter(one_in("scholar_id", 2)).select(F.col("scholar_id").alias("key"), "timestamp"))
    gained = {"citedby": F.col("citedby") + 5, au.COUNTS[1]: F.col(au.COUNTS[1]) + 1}
    table.patch(f.author_rows.join(stale.select("scholar_id"), "scholar_id", "left_semi").withColumns(gained), TODAY)
    return table.read()


def _incremental_publications(f: Frames) -> DataFrame:
    """A seventh of the publications has three more citations, another seventh is gone."""
    rows = pu.eligible_publications(f.pubs, AS_OF)
    table = incremental.RankedTable(f.spark, scratch(f.spark), "author_pub_id", [(["pub_year"], {"num_citations_percentile": "num_citations"})])
    table.build(rows, TODAY)
    more = rows.withColumn("num_citations", F.when(one_in("author_pub_id", 7), F.col("num_citations") + 3).otherwise(F.col("num_citations")))
    changed = incremental.changed_since(more, table.rows.read(), "author_pub_id", ["num_citations"])
    table.patch(changed, TODAY, removed=rows.filter(one_in("title", 7)).join(changed, "author_pub_id", "left_anti"))
    return table.read()


def _stored_deletion(f: Frames) -> DataFrame:
    """Dead profiles deleted from the stored table by tombstones."""
    table = KeyedTable(f.spark, scratch(f.spark), deleted="deleted")
    rows = f.authors.select(F.col("scholar_id").alias("document_id"), "timestamp", F.col("name").alias("data"))
    table.merge(rows.withColumn("deleted", F.lit(False)), TODAY)
    dead = rows.join(refresh.dead_authors(f.stale, _live(f)), F.col("document_id") == F.col("scholar_id"), "left_semi")
    table.merge(documents.tombstones(dead, F.to_timestamp(F.lit(NOW))), TODAY)
    return table.read().select(F.col("document_id").alias("scholar_id"), F.col("data").alias("name"))


def one_in(key: str, n: int) -> Column:
    """True for about one id in ``n``: stands in for tables that the star schema lacks."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") % n == 0


def _worklist(f: Frames) -> DataFrame:
    asked = f.authors.filter(one_in("scholar_id", 5)).select("scholar_id")
    new = f.counted.select(F.col("coauthor_scholar_id").alias("scholar_id")).distinct()
    sizes = documents.slim_author(f.raw_authors).select("scholar_id", F.size("publications").cast("bigint").alias("n_publications"))
    known = f.authors.select("scholar_id", "name").join(sizes, "scholar_id")
    return refresh.refresh_worklist(asked, new, known)


def _fallback(f: Frames) -> DataFrame:
    """Nothing asked for and nobody new: the sampled stale authors."""
    none = f.authors.select("scholar_id").filter(F.lit(False))
    sampled = refresh.authors_to_refresh(f.authors.withColumn("document_id", F.col("scholar_id")), F.to_timestamp(F.lit(NOW)), 20, seed=SEED)
    sizes = documents.slim_author(f.raw_authors).select("scholar_id", F.size("publications").cast("bigint").alias("n_publications"))
    return refresh.refresh_worklist(none, none, f.authors.select("scholar_id", "name").join(sizes, "scholar_id"), sampled)


def _publication_profiles(f: Frames) -> DataFrame:
    p = serving.publication_profiles(f.pubs, f.by_year, F.to_timestamp(F.lit(NOW)))
    years = F.array_join(F.transform("stats", lambda x: F.concat_ws("/", x["citation_year"], x["age"], x["yearly_citations"], x["cumulative_citations"])), ";")
    return p.select("scholar_id", "author_pub_id", "title", "pub_year", "num_citations", "last_modified", "stale", F.coalesce(F.size("stats"), F.lit(0)).cast("bigint").alias("n_years"), years.alias("years"))


def _profiles(f: Frames) -> DataFrame:
    p = serving.author_profiles(f.authors, f.modified, f.served.drop("author"), f.stats)
    return p.select("scholar_id", "name", "last_modified", F.coalesce(F.size("publications"), F.lit(0)).cast("bigint").alias("n_publications"), F.get("publications", F.lit(0))["author_pub_id"].alias("best"), F.col("stats.citedby").alias("citedby"))


def _live(f: Frames) -> DataFrame:
    return f.authors.select("scholar_id", F.when(one_in("scholar_id", 2), "Success").otherwise("Error").alias("status"), F.when(one_in("scholar_id", 3), F.col("name")).alias("name"))


def _liveness(f: Frames) -> DataFrame:
    return refresh.without_dead(f.authors.select("scholar_id", "name"), f.stale, _live(f))


def _big(f: Frames) -> DataFrame:
    rows = f.table("orders").select("o_orderkey", ((F.col("o_orderkey") % 5 - 2).cast("bigint") * F.lit((1 << 61) + 7)).alias("value"))
    return documents.protect_big_integers(rows, ["value"])


def _big_nested(f: Frames) -> DataFrame:
    """Integers inside an array of structs of each customer's orders."""
    big = (F.col("o_orderkey") % 5 - 2).cast("bigint") * F.lit((1 << 61) + 7)
    rows = f.table("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", big.alias("v")))).alias("entries"))
    out = documents.protect_big_integers(rows, ["entries"])
    return out.select("o_custkey", F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["o_orderkey"], x["v"])), ",").alias("entries"))


def _similar_profiles(f: Frames) -> DataFrame:
    """Whole profiles under shared names, some without affiliation or citations."""
    some = lambda c, n: F.when(one_in("scholar_id", n), None).otherwise(F.col(c)).alias(c)
    shared = F.concat(F.lit("Author "), (F.substring("scholar_id", 2, 20).cast("bigint") % 97).cast("string")).alias("name")
    profiles = f.authors.select("scholar_id", shared, some("affiliation", 4), some("email_domain", 5), "citedby")
    return resolution.similar_authors(profiles.select("name"), profiles)


STATE = ["scholar_id", "author_pub_id", "state_year"]

FRAMES = {
    "src_1_authors": lambda f: documents.decode_authors(f.raw_authors),
    "src_2_publications": lambda f: f.pubs.drop("cites_per_year"),
    "src_3_author_publications": lambda f: documents.author_publications(f.raw_authors),
    "src_4_coauthor_network": lambda f: f.edges,
    "src_5_citations_by_year": lambda f: documents.citations_by_year(f.pubs),
    "src_6_prefix_scan": lambda f: documents.decode_publications(_documents(f).prefix("C1:")).select("author_pub_id", "num_citations"),
    "src_7_lookup": lambda f: documents.lookup(f.raw_authors, f.stale.select(F.col("scholar_id").alias("document_id"))).select("document_id", "timestamp"),
    "src_7_lookup_list": _lookup_list,
    "src_8_latest_snapshot": _snapshot,
    "src_8_snapshot_with_deletes": _snapshot_with_deletes,
    "snk_1_upsert_with_deletes": _upsert_with_deletes,
    "snk_2_upsert_restart": _restarted,
    "snk_2_upsert_repeated_epoch": _repeated_epoch,
    "snk_2_upsert_deletes": lambda f: _restarted(f, _with_deletes, deleted="deleted"),
    "snk_3_export_gate": lambda f: _gate(export.CsvExport(f.spark, scratch(f.spark)), lambda: f.with_scores),
    "snk_5_view_gate": lambda f: _gate(export.View(f.spark, scratch(f.spark)), lambda: f.metrics),
    "snk_1_upsert": _upsert,
    "snk_2_upsert_stream": _stream,
    "snk_3_export_all_csv": _csv_all,
    "snk_4_export_author_csv": _csv_author,
    "snk_5_materialize": _view,
    "prj_1_slim_author": lambda f: documents.slim_author(f.raw_authors).select("scholar_id", F.explode("publications").alias("p")).select("scholar_id", F.col("p.author_pub_id").alias("author_pub_id"), F.col("p.num_citations").alias("num_citations"), F.col("p.filled").alias("filled"), F.col("p.bib.pub_year").alias("pub_year")),
    "prj_2_big_integers": _big,
    "prj_3_similar_authors": lambda f: resolution.similar_authors(f.names[1].select("name"), f.names[1].withColumns({"affiliation": F.lit(None).cast("string"), "email_domain": F.lit(None).cast("string"), "citedby": F.length("scholar_id").cast("bigint")})),
    "prj_3_similar_profiles": _similar_profiles,
    "prj_4_eligible": lambda f: f.pubs.filter(eligible(AS_OF)).select("author_pub_id", "pub_year", "num_citations"),
    "prj_5_timeline_slice": lambda f: f.timeline.filter((F.col("citation_year") >= F.col("pub_year")) & (F.col("citation_year") <= AS_OF)),
    "pub_1_publication_current": lambda f: f.current,
    "pub_2_citation_timeline": lambda f: f.timeline,
    "pub_3_timeline_percentiles": lambda f: f.timeline_pct,
    "aut_1_publication_counts": lambda f: au.publication_counts(f.listed, f.current, AS_OF),
    "aut_2_first_cited_year": lambda f: au.first_cited_year(f.listed, f.current, AS_OF),
    "aut_3_author_rows": lambda f: f.author_rows,
    "aut_4_author_current": lambda f: f.stats,
    "aut_5_productivity_curve": lambda f: au.productivity_curve(f.cohort),
    "aut_6_publication_rank": lambda f: f.ranked,
    "aut_7_pip_inputs": lambda f: f.inputs,
    "aut_8_pip_auc": lambda f: f.auc,
    "aut_9_auc_percentile": lambda f: f.scores,
    "tmp_1_publication_state": lambda f: f.state.drop("citations_last_5_years", "copy", "copies", "most_recent"),
    "tmp_2_first_cited_year": lambda f: f.first_year,
    "tmp_3_h_index": lambda f: te.h_index(f.state, "cumulative_citations_at_state_year", "h_index"),
    "tmp_4_recent_citations": lambda f: te.recent_citations(f.state).select(*STATE, "citations_last_5_years"),
    "tmp_5_h_index_5y": lambda f: te.h_index(te.recent_citations(f.state), "citations_last_5_years", "h_index_5y"),
    "tmp_6_yearly_totals": lambda f: te.yearly_totals(te.recent_citations(f.state)),
    "tmp_7_recent_totals": lambda f: te.recent_totals(f.state),
    "tmp_8_temporal_metrics": lambda f: f.metrics,
    "tmp_9_author_temporal": lambda f: f.temporal,
    "net_1_edges": lambda f: f.edges,
    "net_2_unregistered": lambda f: f.counted,
    "net_3_top_unregistered": lambda f: network.top_unregistered(f.counted, 3),
    "net_4_sample": lambda f: network.sample_ids(f.counted, "coauthor_scholar_id", 20, SEED),
    "res_1_split_authors": lambda f: f.names[0],
    "res_2_exact": lambda f: f.resolved,
    "res_3_by_coauthor": lambda f: resolution.resolve_by_coauthor(f.resolved, f.names[1], f.edges),
    "res_4_arrays": lambda f: resolution.resolution_arrays(f.resolved).select("author_pub_id", F.size("author_resolutions").cast("bigint").alias("n"), F.array_join(F.transform("author_resolutions", lambda x: F.concat_ws("/", x["name"], F.coalesce(x["scholar_id"], F.lit("-")), x["method"])), ";").alias("resolutions")),
    "res_5_totals": lambda f: resolution.resolution_totals(f.resolved),
    "srv_1_author_publications": lambda f: f.served,
    "srv_2_author_with_score": lambda f: _serving(f, "authors").author("C7"),
    "srv_1_one_author": lambda f: _serving(f, "publications").author_publications("C7"),
    "srv_4_one_publication": _one_publication,
    "srv_7_incremental_authors": _incremental_authors,
    "srv_7_incremental_publications": _incremental_publications,
    "srv_3_all_authors": lambda f: f.with_scores,
    "srv_4_publication_by_year": lambda f: f.by_year,
    "srv_5_author_by_year": lambda f: _serving(f, "temporal").author_years("C7"),
    "srv_6_last_modified": lambda f: f.modified,
    "srv_7_stale_keys": lambda f: serving.stale_keys(f.modified, f.authors.filter(one_in("scholar_id", 2)).select(F.col("scholar_id").alias("key"), F.col("timestamp"))),
    "srv_8_author_profiles": _profiles,
    "ref_1_stale_documents": lambda f: f.stale,
    "ref_2_authors_to_refresh": lambda f: refresh.authors_to_refresh(f.authors.withColumn("document_id", F.col("scholar_id")), F.to_timestamp(F.lit(NOW)), 20, seed=SEED),
    "ref_3_worklist": _worklist,
    "ref_3_worklist_fallback": _fallback,
    "ref_3_worklist_totals": lambda f: refresh.worklist_totals(_worklist(f)),
    "ref_1_stale_truthy": lambda f: refresh.stale_documents(f.authors.withColumns({"document_id": F.col("scholar_id"), "affiliation": F.when(one_in("scholar_id", 3), "").otherwise(F.col("affiliation"))}), F.to_timestamp(F.lit(NOW)), 90, 500, "affiliation", truthy=True),
    "srv_8_publication_profiles": _publication_profiles,
    "prj_2_big_integers_nested": _big_nested,
    "ref_4_new_tasks": lambda f: refresh.new_tasks(f.authors, "scholar_id", f.pending),
    "ref_5_publication_tasks": lambda f: refresh.publication_tasks(f.listed, f.stale, f.pending),
    "ref_6_without_dead": _liveness,
    "ref_6_stored_deletion": _stored_deletion,
    "jn_3_listed_current": lambda f: au.listed_and_cited(f.listed, f.current, AS_OF),
    "cht_1_scatter": lambda f: serving.scatter_frame(f.served, AS_OF, "num_papers_percentile"),
    "cht_2_timeline": lambda f: serving.timeline_frame(f.by_year),
    "cht_3_metrics": lambda f: serving.metric_frame(f.temporal),
    "cht_4_display": lambda f: serving.display_values(f.stats, AS_OF),
}

#: Joins whose rows are the output of an operator as they are.
JOINS = {
    "jn_1_series_citations": "pub_2_citation_timeline", "jn_10_not_in": "net_2_unregistered", "jn_5_current_stats": "aut_6_publication_rank", "jn_2_listed_current_left": "aut_1_publication_counts",
    "jn_4_author_attributes": "aut_3_author_rows", "jn_6_nearest_points": "aut_7_pip_inputs", "jn_7_listed_timeline": "tmp_1_publication_state",
    "jn_8_temporal_left": "tmp_8_temporal_metrics", "jn_9_range_sum": "tmp_7_recent_totals", "jn_11_scores": "srv_3_all_authors",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Frames(spark, sf_dir))) for name, build in FRAMES.items()}
QUERIES |= {name: QUERIES[host] for name, host in JOINS.items()}
