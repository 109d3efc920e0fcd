"""DuckDB SQL for the registered queries, computed from the star-schema tables without JSON."""

from __future__ import annotations

import re

from .registry import JOINS, SEED

METRICS = ["hindex", "hindex5y", "citedby", "citedby5y", "i10index", "i10index5y"]
COUNTS = ["total_publications", "total_publications_with_citations"]
RANKED = ["total_publications", "total_citations", "total_recent_citations_5y", "h_index", "h_index_5y", "i10_index", "i10_index_5y"]


def pct(keys: str, value: str, out: str) -> str:
    return f"percent_rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS FIRST) AS {out}"


def ts(key: str) -> str:
    return f"(TIMESTAMP '2025-01-01' - to_days(CAST({key} % 200 AS INTEGER)))"


def one_in(key: str, n: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n} = 0)"


def task_key(key: str) -> str:
    return f"replace(replace({key}, ':', '__'), '/', '___')"


def sample(ids: str, key: str, count: int) -> str:
    return f"SELECT {key} FROM (SELECT DISTINCT {key} FROM {ids} WHERE {key} IS NOT NULL) ORDER BY md5('{SEED}:' || {key}), {key} LIMIT {count}"


_metrics = ", ".join(f"CASE WHEN c_custkey % 89 <> 0 THEN (c_custkey * {i + 3}) % {17 + 10 * i} END AS {m}" for i, m in enumerate(METRICS))

CTE = {
    "authors": f"SELECT 'C' || c_custkey AS scholar_id, c_name AS name, n_name AS affiliation, lower(r_name) AS email_domain, {_metrics}, {ts('c_custkey')} AS timestamp FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "line_years": "SELECT l_orderkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY ALL",
    "pubs": f"SELECT 'C' || o_custkey AS scholar_id, 'C' || o_custkey || ':P' || o_orderkey AS author_pub_id, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN 1949 ELSE year(o_orderdate) END::BIGINT AS pub_year, 'Title ' || o_orderkey AS title, o_orderpriority AS author, 'Journal ' || o_orderstatus AS citation, coalesce(floor(n / 10), 0)::BIGINT AS num_citations, CASE WHEN o_orderkey % 7 <> 0 THEN '/related/' || o_orderkey END AS url_related_articles, {ts('o_orderkey')} AS timestamp, o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, sum(q) AS n FROM line_years GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "listed": "SELECT scholar_id, author_pub_id, pub_year FROM pubs WHERE pub_year IS NOT NULL AND scholar_id IN (SELECT scholar_id FROM authors)",
    "cites": "SELECT scholar_id, author_pub_id, pub_year, num_citations AS total_citations, y::BIGINT AS citation_year, (y - pub_year)::BIGINT AS age, floor(q / 10)::BIGINT AS yearly_citations FROM pubs JOIN line_years ON o_orderkey = l_orderkey WHERE pub_year IS NOT NULL",
    "current_pubs": f"SELECT scholar_id, author_pub_id, title, author, pub_year, num_citations, timestamp AS last_updated, {pct('pub_year', 'num_citations', 'num_citations_percentile')} FROM pubs WHERE pub_year > 1950 AND pub_year <= 2025 AND num_citations > 0",
    "series": "SELECT scholar_id, author_pub_id, pub_year, unnest(range(pub_year, 2026))::BIGINT AS citation_year FROM pubs WHERE pub_year <= 2025",
    "timeline": "SELECT s.scholar_id, s.author_pub_id, s.pub_year, (s.citation_year - s.pub_year)::BIGINT AS age, s.citation_year, coalesce(c.yearly_citations, 0)::BIGINT AS yearly_citations, sum(coalesce(c.yearly_citations, 0)) OVER (PARTITION BY s.author_pub_id ORDER BY s.citation_year ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative_citations FROM series s LEFT JOIN cites c ON s.author_pub_id = c.author_pub_id AND s.citation_year = c.citation_year",
    "timeline_pct": f"SELECT *, {pct('pub_year, citation_year', 'yearly_citations', 'perc_pub_year_yearly_citations')}, {pct('pub_year, citation_year', 'cumulative_citations', 'perc_pub_year_cumulative_citations')}, {pct('age', 'yearly_citations', 'perc_age_yearly_citations')}, {pct('age', 'cumulative_citations', 'perc_age_cumulative_citations')} FROM timeline",
    "counts": "SELECT l.scholar_id, count(l.author_pub_id)::BIGINT AS total_publications, count(CASE WHEN p.num_citations > 0 THEN l.author_pub_id END)::BIGINT AS total_publications_with_citations FROM listed l LEFT JOIN current_pubs p USING (author_pub_id) WHERE l.pub_year > 1950 AND l.pub_year <= 2025 GROUP BY l.scholar_id",
    "first_year": "SELECT l.scholar_id, min(l.pub_year)::BIGINT AS year_of_first_pub FROM listed l JOIN current_pubs p USING (author_pub_id) WHERE l.pub_year > 1950 AND l.pub_year <= 2025 GROUP BY l.scholar_id",
    "author_rows": f"SELECT a.scholar_id, name, affiliation, email_domain, {', '.join(METRICS)}, year_of_first_pub, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in COUNTS)}, timestamp AS last_updated FROM authors a LEFT JOIN first_year USING (scholar_id) LEFT JOIN counts USING (scholar_id)",
    "stats": "SELECT *, " + ", ".join(pct("year_of_first_pub", m, f"{m}_percentile") for m in (*METRICS, *COUNTS)) + " FROM author_rows",
    "curve": "SELECT DISTINCT year_of_first_pub, total_publications_with_citations, total_publications_with_citations_percentile FROM stats",
    "ranked": "SELECT p.scholar_id, author_pub_id, num_citations, num_citations_percentile, year_of_first_pub, total_publications_with_citations, row_number() OVER (PARTITION BY p.scholar_id ORDER BY num_citations_percentile DESC, author_pub_id)::BIGINT AS publication_rank FROM current_pubs p JOIN stats s USING (scholar_id)",
    "near": "SELECT r.*, c.total_publications_with_citations_percentile AS p, r.publication_rank - c.total_publications_with_citations AS d FROM ranked r JOIN curve c USING (year_of_first_pub)",
    "inputs": "SELECT scholar_id, author_pub_id, num_citations, num_citations_percentile, publication_rank, CASE WHEN pd IS NULL THEN 0.0 WHEN nd IS NULL THEN 1.0 ELSE (np * pd + pp * nd) / (pd + nd) END AS num_papers_percentile FROM (SELECT scholar_id, author_pub_id, num_citations, num_citations_percentile, publication_rank, arg_min(p, d) FILTER (WHERE d >= 0) AS pp, min(d) FILTER (WHERE d >= 0) AS pd, arg_max(p, d) FILTER (WHERE d < 0) AS np, min(-d) FILTER (WHERE d < 0) AS nd FROM near GROUP BY ALL)",
    "areas": "SELECT scholar_id, num_papers_percentile AS x, publication_rank AS r, (num_papers_percentile - lag(num_papers_percentile) OVER w) * (num_citations_percentile + lag(num_citations_percentile) OVER w) / 2 AS area FROM inputs WINDOW w AS (PARTITION BY scholar_id ORDER BY num_papers_percentile, publication_rank)",
    "auc": "SELECT scholar_id, round(sum(area ORDER BY x, r), 4) AS pip_auc_score FROM areas WHERE area IS NOT NULL GROUP BY scholar_id",
    "scores": f"SELECT scholar_id, year_of_first_pub, pip_auc_score, {pct('year_of_first_pub', 'pip_auc_score', 'pip_auc_score_percentile')} FROM auc JOIN stats USING (scholar_id)",
    "state": "SELECT l.scholar_id, l.author_pub_id, l.pub_year, t.citation_year AS state_year, t.yearly_citations AS yearly_citations_at_state_year, t.cumulative_citations AS cumulative_citations_at_state_year FROM listed l JOIN timeline t ON l.scholar_id = t.scholar_id AND l.author_pub_id = t.author_pub_id",
    "first_any": "SELECT l.scholar_id, min(l.pub_year)::BIGINT AS year_of_first_pub FROM listed l JOIN current_pubs p USING (author_pub_id) GROUP BY l.scholar_id",
    "recent": "SELECT *, sum(yearly_citations_at_state_year) OVER (PARTITION BY scholar_id, author_pub_id ORDER BY state_year ROWS 4 PRECEDING)::BIGINT AS citations_last_5_years FROM state",
    "h": "SELECT scholar_id, state_year, max(least(r, c))::BIGINT AS h_index FROM (SELECT scholar_id, state_year, cumulative_citations_at_state_year AS c, row_number() OVER (PARTITION BY scholar_id, state_year ORDER BY cumulative_citations_at_state_year DESC) AS r FROM state) WHERE c > 0 GROUP BY ALL",
    "h5": "SELECT scholar_id, state_year, max(least(r, c))::BIGINT AS h_index_5y FROM (SELECT scholar_id, state_year, citations_last_5_years AS c, row_number() OVER (PARTITION BY scholar_id, state_year ORDER BY citations_last_5_years DESC) AS r FROM recent WHERE citations_last_5_years > 0) GROUP BY ALL",
    "totals": "SELECT scholar_id, state_year, count(DISTINCT author_pub_id)::BIGINT AS total_publications, sum(cumulative_citations_at_state_year)::BIGINT AS total_citations, count(DISTINCT CASE WHEN cumulative_citations_at_state_year >= 10 THEN author_pub_id END)::BIGINT AS i10_index, count(DISTINCT CASE WHEN citations_last_5_years >= 10 THEN author_pub_id END)::BIGINT AS i10_index_5y FROM recent GROUP BY ALL",
    "year_sums": "SELECT scholar_id, state_year, sum(yearly_citations_at_state_year) AS y FROM state GROUP BY ALL",
    "recent_totals": "SELECT a.scholar_id, a.state_year, sum(b.y)::BIGINT AS total_recent_citations_5y FROM year_sums a JOIN year_sums b ON a.scholar_id = b.scholar_id AND b.state_year BETWEEN a.state_year - 4 AND a.state_year GROUP BY ALL",
    "metrics": "SELECT t.scholar_id, t.state_year, year_of_first_pub, total_publications, total_citations, coalesce(total_recent_citations_5y, 0)::BIGINT AS total_recent_citations_5y, coalesce(h_index, 0)::BIGINT AS h_index, coalesce(h_index_5y, 0)::BIGINT AS h_index_5y, i10_index, i10_index_5y FROM totals t LEFT JOIN recent_totals USING (scholar_id, state_year) LEFT JOIN first_any USING (scholar_id) LEFT JOIN h USING (scholar_id, state_year) LEFT JOIN h5 USING (scholar_id, state_year)",
    "temporal": "SELECT *, " + ", ".join(pct("year_of_first_pub, state_year", m, f"{m}_percentile") for m in RANKED) + " FROM metrics",
    "sup": "SELECT s_suppkey, 'S' || s_suppkey AS id, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "edges": "SELECT a.id AS primary_scholar_id, a.s_name AS primary_name, a.n_name AS primary_affiliation, a.n_name AS primary_email_domain, b.id AS coauthor_scholar_id, b.s_name AS coauthor_name, b.n_name AS coauthor_affiliation FROM (SELECT DISTINCT x.l_suppkey AS p, y.l_suppkey AS q FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_suppkey <> y.l_suppkey AND x.l_suppkey % 2 = 0) JOIN sup a ON p = a.s_suppkey JOIN sup b ON q = b.s_suppkey",
    "counted": "SELECT coauthor_scholar_id, coauthor_name, coauthor_affiliation, primary_email_domain, count(*)::BIGINT AS coauthor_count FROM edges WHERE coauthor_scholar_id NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY ALL",
    "names": "SELECT 'P' || l_orderkey AS author_pub_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1)::BIGINT AS position, 'Supplier ' || (l_suppkey % 70) AS name FROM lineitem WHERE l_orderkey % 7 <> 0",
    "known": "SELECT 'Supplier ' || (s_suppkey % 70) AS name, count(*) AS n, min('S' || s_suppkey) AS id FROM supplier GROUP BY ALL",
    "resolved": "SELECT author_pub_id, position, names.name, CASE WHEN n = 1 THEN id END AS scholar_id, CASE WHEN n = 1 THEN 'local_exact' ELSE 'unresolved' END AS method FROM names LEFT JOIN known ON names.name = known.name",
    "single": "SELECT o.author_pub_id, o.position, min(a.id) AS c FROM (SELECT * FROM resolved WHERE scholar_id IS NULL) o JOIN (SELECT 'Supplier ' || (s_suppkey % 70) AS name, 'S' || s_suppkey AS id FROM supplier) a ON o.name = a.name JOIN (SELECT author_pub_id, scholar_id FROM resolved WHERE scholar_id IS NOT NULL) k ON o.author_pub_id = k.author_pub_id JOIN (SELECT DISTINCT primary_scholar_id, coauthor_scholar_id FROM edges) e ON e.primary_scholar_id = a.id AND e.coauthor_scholar_id = k.scholar_id GROUP BY ALL HAVING count(DISTINCT a.id) = 1",
    "served": "SELECT i.scholar_id, publication_rank, i.author_pub_id, title, author, citation, pub_year, i.num_citations, num_citations_percentile, num_papers_percentile FROM inputs i JOIN pubs p USING (author_pub_id)",
    "with_scores": "SELECT s.*, pip_auc_score, pip_auc_score_percentile FROM stats s LEFT JOIN scores USING (scholar_id)",
    "by_year": "SELECT author_pub_id, pub_year, citation_year, age, yearly_citations, cumulative_citations, perc_pub_year_yearly_citations AS perc_yearly_citations, perc_pub_year_cumulative_citations AS perc_cumulative_citations FROM timeline_pct WHERE citation_year BETWEEN pub_year AND 2025",
    "modified": "SELECT a.scholar_id, greatest(a.timestamp, p.t) AS last_modified FROM authors a LEFT JOIN (SELECT scholar_id, max(timestamp) AS t FROM pubs GROUP BY scholar_id) p USING (scholar_id)",
    "snapshot": "SELECT user_id::VARCHAR AS document_id, ts AS timestamp, props AS data FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "snapshot_with_deletes": "SELECT user_id::VARCHAR AS document_id, ts AS timestamp, props AS data FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_id % 7 <> 0",
    "outdated": f"SELECT m.scholar_id, m.last_modified FROM modified m LEFT JOIN (SELECT scholar_id, timestamp AS cached FROM authors WHERE {one_in('scholar_id', 2)}) c ON m.scholar_id = c.scholar_id WHERE cached IS NULL OR last_modified > cached",
    "stale": "SELECT scholar_id, timestamp FROM authors WHERE timestamp < TIMESTAMP '2025-01-15' - INTERVAL 90 DAYS ORDER BY timestamp, scholar_id LIMIT 500",
    "pending": f"SELECT {task_key('scholar_id')} AS task_key FROM authors WHERE {one_in('scholar_id', 3)}",
    "sizes": "SELECT scholar_id, count(*)::BIGINT AS n_publications FROM pubs GROUP BY scholar_id",
}


def sql(select: str) -> str:
    """``select`` behind the CTEs that it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b\w+\b", text)) & CTE.keys() - needed:
            if re.search(rf"(FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                visit(CTE[name])

    visit(select)
    ctes = ", ".join(f"{k} AS ({v})" for k, v in CTE.items() if k in needed)
    return f"WITH {ctes} {select}" if ctes else select


def everything(name: str, columns: str = "*") -> str:
    return sql(f"SELECT {columns} FROM {name}")


GATE = "SELECT call, n, refreshed_at FROM (SELECT count(*)::BIGINT AS n FROM {}) CROSS JOIN (VALUES (1, TIMESTAMP '2025-01-15 00:00:00'), (2, TIMESTAMP '2025-01-15 00:00:00'), (3, TIMESTAMP '2025-01-16 00:00:00')) v(call, refreshed_at)"

SQL = {
    "src_1_authors": everything("authors"),
    "src_2_publications": everything("pubs", "* EXCLUDE (o_orderkey)"),
    "src_3_author_publications": everything("listed"),
    "src_4_coauthor_network": everything("edges"),
    "src_5_citations_by_year": everything("cites"),
    "src_6_prefix_scan": sql("SELECT author_pub_id, num_citations FROM pubs WHERE starts_with(author_pub_id, 'C1:')"),
    "src_7_lookup": sql("SELECT scholar_id AS document_id, timestamp FROM stale"),
    "src_8_latest_snapshot": everything("snapshot"),
    "src_7_lookup_list": sql("SELECT scholar_id AS document_id, timestamp FROM stale"),
    "src_8_snapshot_with_deletes": everything("snapshot_with_deletes"),
    "snk_1_upsert_with_deletes": "SELECT user_id::VARCHAR AS document_id, ts AS timestamp, props AS data FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_id % 7 = 0)::INTEGER DESC, props DESC) = 1) WHERE event_id % 7 <> 0",
    "snk_2_upsert_restart": everything("snapshot"),
    "snk_2_upsert_repeated_epoch": everything("snapshot"),
    "snk_2_upsert_deletes": everything("snapshot_with_deletes"),
    "snk_3_export_gate": sql(GATE.format("with_scores")),
    "snk_5_view_gate": sql(GATE.format("metrics")),
    "srv_1_one_author": sql("SELECT * FROM served WHERE scholar_id = 'C7'"),
    "srv_4_one_publication": sql("SELECT * FROM by_year WHERE author_pub_id = (SELECT min(author_pub_id) FROM pubs WHERE pub_year <= 2025)"),
    "srv_7_incremental_authors": sql("SELECT *, " + ", ".join(pct("year_of_first_pub", m, f"{m}_percentile") for m in (*METRICS, *COUNTS)) + " FROM (SELECT * REPLACE (CASE WHEN scholar_id IN (SELECT scholar_id FROM outdated) THEN citedby + 5 ELSE citedby END AS citedby, CASE WHEN scholar_id IN (SELECT scholar_id FROM outdated) THEN total_publications_with_citations + 1 ELSE total_publications_with_citations END AS total_publications_with_citations) FROM author_rows)"),
    "srv_7_incremental_publications": sql(f"SELECT *, {pct('pub_year', 'num_citations', 'num_citations_percentile')} FROM (SELECT * EXCLUDE (num_citations_percentile) REPLACE (CASE WHEN {one_in('author_pub_id', 7)} THEN num_citations + 3 ELSE num_citations END AS num_citations) FROM current_pubs WHERE {one_in('author_pub_id', 7)} OR NOT {one_in('title', 7)})"),
    "ref_6_stored_deletion": sql(f"SELECT scholar_id, name FROM authors WHERE NOT (scholar_id IN (SELECT scholar_id FROM stale) AND {one_in('scholar_id', 2)} AND (NOT {one_in('scholar_id', 3)} OR name = ''))"),
    "snk_1_upsert": "SELECT user_id::VARCHAR AS document_id, ts AS timestamp, props AS data FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, props DESC) = 1",
    "snk_2_upsert_stream": everything("snapshot"),
    "snk_3_export_all_csv": everything("with_scores"),
    "snk_4_export_author_csv": everything("served"),
    "snk_5_materialize": everything("metrics"),
    "prj_1_slim_author": sql("SELECT scholar_id, author_pub_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 ELSE 0 END::BIGINT AS num_citations, false AS filled, pub_year::VARCHAR AS pub_year FROM pubs WHERE scholar_id IN (SELECT 'C' || c_custkey FROM customer)"),
    "prj_2_big_integers": "SELECT o_orderkey, CASE WHEN abs(v) > 4611686018427387904 THEN '\"' || v || '\"' ELSE v::VARCHAR END AS value FROM (SELECT o_orderkey, (o_orderkey % 5 - 2) * 2305843009213693959 AS v FROM orders)",
    "prj_3_similar_authors": "SELECT name, '' AS affiliation, '' AS email_domain, citedby, scholar_id, position FROM (SELECT 'Supplier ' || (s_suppkey % 70) AS name, length('S' || s_suppkey)::BIGINT AS citedby, 'S' || s_suppkey AS scholar_id, row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY length('S' || s_suppkey) DESC, 'S' || s_suppkey)::BIGINT AS position FROM supplier) WHERE position <= 10",
    "prj_3_similar_profiles": sql(f"SELECT name, affiliation, email_domain, citedby, scholar_id, position FROM (SELECT 'Author ' || (substr(scholar_id, 2)::BIGINT % 97) AS name, CASE WHEN {one_in('scholar_id', 4)} OR affiliation IS NULL THEN '' ELSE affiliation END AS affiliation, CASE WHEN {one_in('scholar_id', 5)} OR email_domain IS NULL THEN '' ELSE email_domain END AS email_domain, coalesce(citedby, 0)::BIGINT AS citedby, scholar_id, row_number() OVER (PARTITION BY substr(scholar_id, 2)::BIGINT % 97 ORDER BY coalesce(citedby, 0) DESC, scholar_id)::BIGINT AS position FROM authors) WHERE position <= 10"),
    "prj_4_eligible": sql("SELECT author_pub_id, pub_year, num_citations FROM pubs WHERE pub_year > 1950 AND pub_year <= 2025 AND num_citations > 0"),
    "prj_5_timeline_slice": sql("SELECT * FROM timeline WHERE citation_year BETWEEN pub_year AND 2025"),
    "pub_1_publication_current": everything("current_pubs"),
    "pub_2_citation_timeline": everything("timeline"),
    "pub_3_timeline_percentiles": everything("timeline_pct"),
    "aut_1_publication_counts": everything("counts"),
    "aut_2_first_cited_year": everything("first_year"),
    "aut_3_author_rows": everything("author_rows"),
    "aut_4_author_current": everything("stats"),
    "aut_5_productivity_curve": everything("curve"),
    "aut_6_publication_rank": everything("ranked"),
    "aut_7_pip_inputs": everything("inputs"),
    "aut_8_pip_auc": everything("auc"),
    "aut_9_auc_percentile": everything("scores"),
    "tmp_1_publication_state": everything("state"),
    "tmp_2_first_cited_year": everything("first_any"),
    "tmp_3_h_index": everything("h"),
    "tmp_4_recent_citations": everything("recent", "scholar_id, author_pub_id, state_year, citations_last_5_years"),
    "tmp_5_h_index_5y": everything("h5"),
    "tmp_6_yearly_totals": everything("totals"),
    "tmp_7_recent_totals": everything("recent_totals"),
    "tmp_8_temporal_metrics": everything("metrics"),
    "tmp_9_author_temporal": everything("temporal"),
    "net_1_edges": everything("edges"),
    "net_2_unregistered": everything("counted"),
    "net_3_top_unregistered": sql("SELECT coauthor_scholar_id, coauthor_name, sum(coauthor_count)::BIGINT AS total_count FROM counted GROUP BY ALL ORDER BY total_count DESC, coauthor_scholar_id, coauthor_name LIMIT 300"),
    "net_4_sample": sql(sample("counted", "coauthor_scholar_id", 20)),
    "res_1_split_authors": everything("names"),
    "res_2_exact": everything("resolved"),
    "res_3_by_coauthor": sql("SELECT r.author_pub_id, r.position, r.name, coalesce(r.scholar_id, s.c) AS scholar_id, CASE WHEN r.scholar_id IS NULL AND s.c IS NOT NULL THEN 'coauthor' ELSE r.method END AS method FROM resolved r LEFT JOIN single s ON r.author_pub_id = s.author_pub_id AND r.position = s.position"),
    "res_4_arrays": sql("SELECT author_pub_id, count(*)::BIGINT AS n, string_agg(name || '/' || coalesce(scholar_id, '-') || '/' || method, ';' ORDER BY position) AS resolutions FROM resolved GROUP BY author_pub_id"),
    "res_5_totals": sql("SELECT count(DISTINCT author_pub_id)::BIGINT AS pubs, count(*)::BIGINT AS authors, count(scholar_id)::BIGINT AS resolved, (count(*) - count(scholar_id))::BIGINT AS unresolved, round(100.0::DOUBLE * count(scholar_id) / count(*), 1) AS percent FROM resolved"),
    "srv_1_author_publications": everything("served"),
    "srv_2_author_with_score": sql("SELECT * FROM with_scores WHERE scholar_id = 'C7'"),
    "srv_3_all_authors": everything("with_scores"),
    "srv_4_publication_by_year": everything("by_year"),
    "srv_5_author_by_year": sql("SELECT * FROM temporal WHERE scholar_id = 'C7'"),
    "srv_6_last_modified": everything("modified"),
    "srv_7_stale_keys": sql(f"SELECT m.scholar_id, m.last_modified FROM modified m LEFT JOIN (SELECT scholar_id, timestamp AS cached FROM authors WHERE {one_in('scholar_id', 2)}) c ON m.scholar_id = c.scholar_id WHERE cached IS NULL OR last_modified > cached"),
    "ref_1_stale_documents": everything("stale"),
    "ref_2_authors_to_refresh": sql(sample("(SELECT scholar_id FROM authors WHERE timestamp < TIMESTAMP '2025-01-15' - INTERVAL 90 DAYS ORDER BY timestamp, scholar_id LIMIT 2000)", "scholar_id", 20)),
    "ref_3_worklist": sql(f"SELECT i.scholar_id, CASE WHEN a.scholar_id IS NULL THEN 'unknown' WHEN n_publications IS NULL AND name IS NULL THEN 'empty' ELSE 'known' END AS status, name, coalesce(n_publications, 0)::BIGINT AS n_publications FROM (SELECT scholar_id FROM authors WHERE {one_in('scholar_id', 5)} UNION SELECT coauthor_scholar_id FROM counted) i LEFT JOIN authors a ON i.scholar_id = a.scholar_id LEFT JOIN sizes s ON a.scholar_id = s.scholar_id"),
    "ref_3_worklist_fallback": sql("SELECT i.scholar_id, CASE WHEN a.scholar_id IS NULL THEN 'unknown' WHEN n_publications IS NULL AND name IS NULL THEN 'empty' ELSE 'known' END AS status, name, coalesce(n_publications, 0)::BIGINT AS n_publications FROM (" + sample("(SELECT scholar_id FROM authors WHERE timestamp < TIMESTAMP '2025-01-15' - INTERVAL 90 DAYS ORDER BY timestamp, scholar_id LIMIT 2000)", "scholar_id", 20) + ") i LEFT JOIN authors a ON i.scholar_id = a.scholar_id LEFT JOIN sizes s ON a.scholar_id = s.scholar_id"),
    "ref_3_worklist_totals": sql(f"SELECT status, count(*)::BIGINT AS ids, sum(n_publications)::BIGINT AS publications FROM (SELECT i.scholar_id, CASE WHEN a.scholar_id IS NULL THEN 'unknown' WHEN n_publications IS NULL AND name IS NULL THEN 'empty' ELSE 'known' END AS status, name, coalesce(n_publications, 0)::BIGINT AS n_publications FROM (SELECT scholar_id FROM authors WHERE {one_in('scholar_id', 5)} UNION SELECT coauthor_scholar_id FROM counted) i LEFT JOIN authors a ON i.scholar_id = a.scholar_id LEFT JOIN sizes s ON a.scholar_id = s.scholar_id) GROUP BY status"),
    "ref_1_stale_truthy": sql(f"SELECT affiliation, timestamp FROM (SELECT CASE WHEN {one_in('scholar_id', 3)} THEN '' ELSE affiliation END AS affiliation, timestamp FROM authors WHERE timestamp < TIMESTAMP '2025-01-15' - INTERVAL 90 DAYS ORDER BY timestamp, scholar_id LIMIT 500) WHERE affiliation <> ''"),
    "srv_8_publication_profiles": sql("SELECT p.scholar_id, p.author_pub_id, p.title, p.pub_year, p.num_citations, p.timestamp AS last_modified, p.timestamp < TIMESTAMP '2025-01-15' - INTERVAL 90 DAYS AS stale, coalesce(n, 0)::BIGINT AS n_years, years FROM pubs p LEFT JOIN (SELECT author_pub_id, count(*) AS n, string_agg(citation_year || '/' || age || '/' || yearly_citations || '/' || cumulative_citations, ';' ORDER BY citation_year) AS years FROM by_year GROUP BY author_pub_id) y ON p.author_pub_id = y.author_pub_id"),
    "prj_2_big_integers_nested": "SELECT o_custkey, string_agg(o_orderkey || ':' || CASE WHEN abs(v) > 4611686018427387904 THEN '\"' || v || '\"' ELSE v::VARCHAR END, ',' ORDER BY o_orderkey) AS entries FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 5 - 2) * 2305843009213693959 AS v FROM orders) GROUP BY o_custkey",
    "ref_4_new_tasks": sql(f"SELECT DISTINCT {task_key('scholar_id')} AS task_key FROM authors EXCEPT SELECT task_key FROM pending"),
    "ref_5_publication_tasks": sql(f"SELECT {task_key('author_pub_id')} AS task_key FROM listed WHERE scholar_id IN (SELECT scholar_id FROM stale) EXCEPT SELECT task_key FROM pending"),
    "ref_6_without_dead": sql(f"SELECT scholar_id, name FROM authors WHERE NOT (scholar_id IN (SELECT scholar_id FROM stale) AND {one_in('scholar_id', 2)} AND (NOT {one_in('scholar_id', 3)} OR name = ''))"),
    "jn_3_listed_current": sql("SELECT l.* FROM listed l JOIN current_pubs p ON l.author_pub_id = p.author_pub_id WHERE l.pub_year > 1950 AND l.pub_year <= 2025"),
    "cht_1_scatter": sql("SELECT scholar_id, author_pub_id, (2025 - pub_year + 1)::BIGINT AS age, num_papers_percentile * 100 AS x, num_citations_percentile * 100 AS y FROM served WHERE pub_year IS NOT NULL"),
    "cht_2_timeline": sql("SELECT author_pub_id, make_date(citation_year, 1, 1) AS year, yearly_citations, perc_yearly_citations, perc_cumulative_citations FROM by_year"),
    "cht_3_metrics": sql(" UNION ALL ".join(f"SELECT scholar_id, state_year, '{m}' AS metric, {m} AS value, {m}_percentile * 100 AS percentile FROM temporal" for m in ("h_index", "total_citations", "i10_index", "h_index_5y"))),
    "cht_4_display": sql("SELECT scholar_id, " + ", ".join(f"round(100 * {c}_percentile, 2) AS {c}_shown" for c in ("hindex", "citedby", "total_publications")) + ", (2025 - year_of_first_pub + 1)::BIGINT AS years_active FROM stats"),
    "srv_8_author_profiles": sql("SELECT a.scholar_id, a.name, last_modified, coalesce(n, 0)::BIGINT AS n_publications, best, citedby FROM authors a LEFT JOIN modified USING (scholar_id) LEFT JOIN (SELECT scholar_id, count(*) AS n, arg_min(author_pub_id, publication_rank) AS best FROM served GROUP BY ALL) USING (scholar_id)"),
}
SQL |= {name: SQL[host] for name, host in JOINS.items() if host in SQL}
