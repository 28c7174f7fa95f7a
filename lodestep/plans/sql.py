"""DuckDB SQL for the query catalogue."""

from __future__ import annotations

from ..functions.names import KINDS
from . import fixtures as fx
from .queries import BROKEN, PREFERRED

_FX = ",\n".join(f"{name} AS ({body})" for name, body in fx.VIEWS.items())
_PAIRS = "pairs AS (SELECT CAST(a AS BIGINT) AS pair_id, CAST(b AS BIGINT) AS source_in, CAST(c AS BIGINT) AS target_in FROM (VALUES " + ", ".join(map(str, fx.PAIRS)) + ") v(a, b, c))"
_ALL_PAIRS = f"pairs AS ({fx.ALL_PAIRS})"
_REDIRECTS = """raw AS (SELECT DISTINCT r.rd_from AS s, p.page_id AS t FROM fx_redirect r JOIN fx_page p ON p.namespace = r.rd_namespace AND p.title = r.rd_title WHERE r.rd_from <> p.page_id),
w(s, t) AS (SELECT s, t FROM raw UNION SELECT w.s, raw.t FROM w JOIN raw ON raw.s = w.t),
g_redirects AS (SELECT s AS source, t AS target FROM w WHERE t NOT IN (SELECT s FROM raw))"""
_ALL_LINKS = """g_all AS (SELECT coalesce(r1.target, pl.pl_from) AS source, coalesce(r2.target, p.page_id) AS target
FROM fx_pagelinks pl LEFT JOIN fx_linktarget lt ON lt.lt_id = pl.pl_target_id LEFT JOIN fx_page p ON p.namespace = lt.lt_namespace AND p.title = lt.lt_title
LEFT JOIN g_redirects r1 ON r1.source = pl.pl_from LEFT JOIN g_redirects r2 ON r2.source = p.page_id)"""
_LINKS = "g_links AS (SELECT DISTINCT source, target FROM g_all WHERE target IS NOT NULL AND source <> target)"
_PATHS = """pr AS (SELECT pair_id, coalesce(a.target, source_in) AS s, a.target IS NOT NULL AS sr, coalesce(b.target, target_in) AS t, b.target IS NOT NULL AS tr
  FROM pairs LEFT JOIN g_redirects a ON a.source = source_in LEFT JOIN g_redirects b ON b.source = target_in),
f(pair_id, n, d) AS (SELECT pair_id, s, 0 FROM pr UNION SELECT f.pair_id, l.target, d + 1 FROM f JOIN g_links l ON l.source = f.n WHERE d < 20),
fd AS (SELECT pair_id, n, min(d) AS d FROM f GROUP BY ALL),
b(pair_id, n, d) AS (SELECT pr.pair_id, pr.t, fd.d FROM pr JOIN fd ON fd.pair_id = pr.pair_id AND fd.n = pr.t UNION SELECT b.pair_id, l.source, b.d - 1 FROM b JOIN g_links l ON l.target = b.n JOIN fd ON fd.pair_id = b.pair_id AND fd.n = l.source AND fd.d = b.d - 1),
dag AS (SELECT x.pair_id, x.n AS source, l.target, x.d FROM b x JOIN g_links l ON l.source = x.n JOIN b y ON y.pair_id = x.pair_id AND y.n = l.target AND y.d = x.d + 1),
p(pair_id, n, path) AS (SELECT pr.pair_id, pr.s, [pr.s] FROM pr JOIN fd ON fd.pair_id = pr.pair_id AND fd.n = pr.t UNION ALL SELECT p.pair_id, g.target, list_append(p.path, g.target) FROM p JOIN dag g ON g.pair_id = p.pair_id AND g.source = p.n),
whole AS (SELECT pr.pair_id, p.path FROM pr JOIN p ON p.pair_id = pr.pair_id AND p.n = pr.t),
ranked AS (SELECT pair_id, path, row_number() OVER (PARTITION BY pair_id ORDER BY [x::VARCHAR FOR x IN path]) AS rank FROM whole),
shown AS (SELECT * FROM ranked WHERE rank <= 8),
total AS (SELECT pr.pair_id, pr.s AS source, pr.sr AS source_is_redirect, pr.t AS target, pr.tr AS target_is_redirect, CAST(coalesce(max(len(whole.path)) - 1, 0) AS BIGINT) AS length, CAST(count(whole.path) AS BIGINT) AS count
  FROM pr LEFT JOIN whole ON whole.pair_id = pr.pair_id GROUP BY ALL)"""
_STEPS = "steps AS (SELECT pair_id, rank, unnest(path) AS page_id, unnest(range(len(path))) AS position FROM shown)"

_DRAWN = """drawn AS (SELECT pair_id, 1 + CAST('0x' || substr(md5('7:' || pair_id || ':1'), 1, 15) AS BIGINT) % (count - 1) AS first,
  1 + CAST('0x' || substr(md5('7:' || pair_id || ':2'), 1, 15) AS BIGINT) % count AS second FROM total WHERE count > 2)"""


def _with(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((_FX, *parts)) + "\n" + body


def _clean(body: str) -> str:
    return _with(body, _REDIRECTS)


def _graph(body: str) -> str:
    return _with(body, _REDIRECTS, _ALL_LINKS, _LINKS)


def _paths(body: str, sparse: bool = False) -> str:
    out = _with(body, _PAIRS, _REDIRECTS, _ALL_LINKS, _LINKS, _PATHS, _STEPS)
    return out.replace("b.l_linenumber = a.l_linenumber + 1", "b.l_linenumber = a.l_linenumber + 1" + fx.SPARSE) if sparse else out


def _paths_all(body: str) -> str:
    return _with(body, _ALL_PAIRS, _REDIRECTS, _ALL_LINKS, _LINKS, _PATHS)


def _reasons(relation: str, id_: str, namespace: str, title: str) -> str:
    self_ = "WHEN p.page_id = r.rd_from THEN 'self_redirect'" if relation == "fx_redirect" else ""
    return f"""SELECT CASE {self_} WHEN p.page_id IS NOT NULL THEN 'stored' WHEN r.{namespace} IN (SELECT namespace FROM fx_page) THEN 'missing_target_title' ELSE 'missing_target_namespace' END AS reason
FROM {relation} r LEFT JOIN fx_page p ON p.namespace = r.{namespace} AND p.title = r.{title}"""


_LINK_REASONS = "SELECT CASE WHEN target IS NULL THEN 'missing_linktarget' WHEN source = target THEN 'self_link' ELSE 'stored' END AS reason FROM g_all"
_ADJACENT = "SELECT {0} AS page_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST({1} AS VARCHAR), ',' ORDER BY {1}) AS ids FROM g_links GROUP BY 1"
_LOOKUP = "SELECT k.page_id, coalesce(string_agg(CAST({1} AS VARCHAR), ',' ORDER BY {1}), '') AS value FROM (" + fx.ALL_IDS + ") k LEFT JOIN g_links l ON l.{0} = k.page_id GROUP BY 1"
_NAMES = f"names AS ({fx.NAMES}), parsed AS (SELECT name, nullif(regexp_extract(name, '^wp-([a-zA-Z]+)-([0-9]+)$', 1), '') AS language_code, nullif(regexp_extract(name, '^wp-([a-zA-Z]+)-([0-9]+)$', 2), '') AS date_code FROM names)"
_NEWEST = "newest AS (SELECT language_code, max(date_code) AS date_code FROM parsed WHERE language_code IS NOT NULL GROUP BY 1)"
_TITLES = "t AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)"
_DUMP = r"'^([a-zA-Z]+)wiki-([0-9]+)-(.+)\.sql\.gz$'"


def _stats() -> str:
    parts = []
    for relation, inner in (
        ("page", "SELECT 'stored' AS reason FROM fx_page"),
        ("redirect", _reasons("fx_redirect", "rd_from", "rd_namespace", "rd_title") + " WHERE r.rd_title IS NOT NULL"),
        ("linktarget", _reasons("fx_linktarget", "lt_id", "lt_namespace", "lt_title")),
        ("pagelinks", _LINK_REASONS),
    ):
        bad = sum("4294967296" in r or "18446744073709551616" in r for r in BROKEN[relation])
        parts.append(f"SELECT '{relation}' AS relation, reason FROM ({inner})")
        parts += [f"SELECT '{relation}' AS relation, 'malformed' AS reason"] * bad
    every = " UNION ALL ".join(parts)
    return _with(
        """SELECT relation, reason, n, round(n / attempted, 9) AS share FROM
(SELECT relation, reason, count(*) AS n FROM every GROUP BY ALL UNION ALL SELECT relation, 'attempted', count(*) FROM every GROUP BY ALL) JOIN (SELECT relation, count(*) AS attempted FROM every GROUP BY ALL) USING (relation)""",
        _REDIRECTS,
        _ALL_LINKS,
        f"every AS ({every})",
    )


ORACLES = {
    "page_index": _with("SELECT CAST(namespace AS BIGINT) AS namespace, count(*) AS n_titles FROM fx_page GROUP BY 1"),
    "page_key_check": _with("SELECT count(*) AS violations FROM (SELECT namespace, title FROM fx_page GROUP BY ALL HAVING count(DISTINCT page_id) > 1)"),
    "dump_roundtrip_page": _with("SELECT page_id, CAST(namespace AS BIGINT) AS namespace, title FROM fx_page"),
    "dump_roundtrip_redirect": _with("SELECT rd_from, CAST(rd_namespace AS BIGINT) AS rd_namespace, rd_title FROM fx_redirect WHERE rd_title IS NOT NULL"),
    "dump_roundtrip_linktarget": _with("SELECT CAST(lt_id AS BIGINT) AS lt_id, CAST(lt_namespace AS BIGINT) AS lt_namespace, lt_title FROM fx_linktarget"),
    "dump_roundtrip_pagelinks": _with("SELECT pl_from, CAST(pl_target_id AS BIGINT) AS pl_target_id FROM fx_pagelinks"),
    "parse_stats": _stats(),
    "redirect_resolve": _clean("SELECT s AS source, t AS target FROM raw"),
    "redirect_skip_reasons": _with(f"SELECT reason, count(*) AS n FROM ({_reasons('fx_redirect', 'rd_from', 'rd_namespace', 'rd_title')}) GROUP BY 1"),
    "redirect_compress": _clean("SELECT source, target FROM g_redirects"),
    "linktarget_resolve": _with("SELECT CAST(lt_id AS BIGINT) AS linktarget_id, page_id FROM fx_linktarget JOIN fx_page ON namespace = lt_namespace AND title = lt_title"),
    "linktarget_skip_reasons": _with(f"SELECT reason, count(*) AS n FROM ({_reasons('fx_linktarget', 'lt_id', 'lt_namespace', 'lt_title')}) GROUP BY 1"),
    "links_resolved": _graph("SELECT source, target, count(*) AS n FROM g_all WHERE target IS NOT NULL AND source <> target GROUP BY ALL"),
    "link_skip_reasons": _graph(f"SELECT reason, count(*) AS n FROM ({_LINK_REASONS}) GROUP BY 1"),
    "links": _graph("SELECT source, target FROM g_links"),
    "incoming_adjacency": _graph(_ADJACENT.format("target", "source")),
    "outgoing_adjacency": _graph(_ADJACENT.format("source", "target")),
    "lookup_redirect": _clean(f"SELECT k.page_id, r.target AS value FROM ({fx.ALL_IDS}) k LEFT JOIN g_redirects r ON r.source = k.page_id"),
    "lookup_incoming": _graph(_LOOKUP.format("target", "source")),
    "lookup_outgoing": _graph(_LOOKUP.format("source", "target")),
    "indexed_lookups": _graph(
        """SELECT k.page_id, kind, CASE kind WHEN 'redirect' THEN CAST(r.target AS VARCHAR) WHEN 'incoming' THEN coalesce(i.ids, '') ELSE coalesce(o.ids, '') END AS value
FROM (SELECT page_id FROM fx_page WHERE page_id % 100 = 0) k, (VALUES ('redirect'), ('incoming'), ('outgoing')) v(kind) LEFT JOIN g_redirects r ON r.source = k.page_id
LEFT JOIN (SELECT target, string_agg(CAST(source AS VARCHAR), ',' ORDER BY source) AS ids FROM g_links GROUP BY 1) i ON i.target = k.page_id
LEFT JOIN (SELECT source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS ids FROM g_links GROUP BY 1) o ON o.source = k.page_id"""
    ),
    "list_parts": _graph("SELECT target AS page_id, CAST(count(*) AS BIGINT) AS n, true AS bounded FROM g_links GROUP BY 1"),
    "dump_split_pagelinks": _with("SELECT pl_from, CAST(pl_target_id AS BIGINT) AS pl_target_id FROM fx_pagelinks"),
    "batched_links": _graph("SELECT source, target FROM g_links"),
    "batched_incoming": _graph(_ADJACENT.format("target", "source")),
    "redirect_key_check": _clean("SELECT count(*) AS violations FROM (SELECT s FROM raw GROUP BY s HAVING count(DISTINCT t) > 1)"),
    "linktarget_key_check": _with("SELECT count(*) AS violations FROM (SELECT lt_id FROM fx_linktarget JOIN fx_page ON namespace = lt_namespace AND title = lt_title GROUP BY lt_id HAVING count(DISTINCT page_id) > 1)"),
    "build_counts": _graph(
        """SELECT kind, before, after, greatest(before - after, 0) AS dropped FROM (
SELECT 'redirects' AS kind, (SELECT count(*) FROM raw) AS before, (SELECT count(*) FROM g_redirects) AS after
UNION ALL SELECT 'links', (SELECT count(*) FROM g_all WHERE target IS NOT NULL AND source <> target), (SELECT count(*) FROM g_links))"""
    ),
    "checksum_catalog": f"""WITH s AS ({fx.SUMS}), k AS (SELECT *, regexp_extract(name, {_DUMP}, 3) AS kind FROM s)
SELECT kind, 'en' AS language_code, '20240101' AS date_code, arg_min(name, line) AS file_name, sha1(arg_min(content, line)) AS sha1 FROM k WHERE kind IN ({", ".join(f"'{x}'" for x in KINDS)}) GROUP BY kind""",
    "shortest_paths_page_arrays": _paths("SELECT pair_id, rank, string_agg(concat(page_id, coalesce(':' || title, '')), ' > ' ORDER BY position) AS pages FROM steps LEFT JOIN fx_page USING (page_id) GROUP BY ALL"),
    "title_first_match": f"""WITH {_TITLES}, f AS (SELECT page_id, title, lower(strip_accents(title)) AS folded FROM t), q AS (SELECT lower(strip_accents(upper(min(title)))) AS query FROM t WHERE title <> '')
SELECT page_id, title FROM (SELECT page_id, title, folded = query AS same FROM f, q WHERE starts_with(folded, query) ORDER BY CASE WHEN folded = query THEN 0 ELSE 1 END, length(title), title, page_id LIMIT 5) WHERE same ORDER BY title, page_id LIMIT 1""",
    "bfs_levels": _with(
        "SELECT CAST(d AS BIGINT) AS depth, count(*) AS n FROM (SELECT n, min(d) AS d FROM lv GROUP BY n) GROUP BY 1",
        _REDIRECTS,
        _ALL_LINKS,
        _LINKS,
        "lv(n, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT l.target, d + 1 FROM lv JOIN g_links l ON l.source = lv.n WHERE d < 20)",
    ),
    "shortest_path_summary": _paths("SELECT * FROM total"),
    "shortest_path_summary_sparse": _paths("SELECT * FROM total", sparse=True),
    "shortest_path_links": _paths("SELECT pair_id, source, target FROM dag"),
    "shortest_path_summary_all": _paths_all("SELECT * FROM total"),
    "shortest_path_links_all": _paths_all("SELECT pair_id, source, target FROM dag"),
    "shortest_path_adjacency": _paths("SELECT pair_id, source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets FROM dag GROUP BY ALL"),
    "shortest_path_json": _paths(
        """SELECT pair_id, concat('{"source":', source, ',"sourceIsRedirect":', source_is_redirect, ',"target":', target, ',"targetIsRedirect":', target_is_redirect,
 ',"links":{', coalesce(m.links, ''), '},"languageCode":"en","dateCode":"20240101","length":', length, ',"count":', count, '}') AS json
FROM total LEFT JOIN (SELECT pair_id, string_agg(concat('"', source, '":[', targets, ']'), ',' ORDER BY CAST(source AS VARCHAR)) AS links
  FROM (SELECT pair_id, source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets FROM dag GROUP BY ALL) GROUP BY pair_id) m USING (pair_id)"""
    ),
    "shortest_paths_all": _paths("SELECT pair_id, rank, array_to_string(path, ',') AS path FROM ranked"),
    "shortest_paths_first8": _paths("SELECT pair_id, rank, array_to_string(path, ',') AS path FROM shown"),
    "shortest_paths_numbered": _paths("SELECT pair_id, rank, array_to_string(path, ',') AS path FROM ranked"),
    "shortest_paths_middle_all": _paths_all("SELECT pair_id, rank, array_to_string(path, ',') AS path FROM ranked JOIN total USING (pair_id) WHERE rank = (count + 1) // 2"),
    "shortest_paths_sample": _paths(
        """SELECT pair_id, rank, array_to_string(path, ',') AS path FROM ranked JOIN total USING (pair_id) LEFT JOIN drawn USING (pair_id) WHERE count <= 2
OR rank = first OR rank = CASE WHEN second = first THEN count ELSE second END"""
    ).replace(_STEPS, _DRAWN),
    "shortest_paths_titled": _paths("SELECT pair_id, rank, CAST(position AS BIGINT) AS position, page_id, title FROM steps LEFT JOIN fx_page USING (page_id)"),
    "pages_to_fetch": _paths("SELECT pair_id, page_id, min(struct_pack(r := rank, p := position)).r AS rank, CAST(min(struct_pack(r := rank, p := position)).p AS BIGINT) AS position FROM steps GROUP BY ALL"),
    "graph_nodes": _paths(
        """SELECT n.pair_id, id, title, degree, title || CASE WHEN (id = source AND source_is_redirect) OR (id = target AND target_is_redirect) THEN ' (redirected)' ELSE '' END AS label
FROM (SELECT pair_id, page_id AS id, min(title) AS title, CAST(min(position) AS BIGINT) AS degree FROM steps LEFT JOIN fx_page USING (page_id) GROUP BY ALL) n JOIN total USING (pair_id)"""
    ),
    "graph_edges": _paths("SELECT a.pair_id, a.page_id AS source, b.page_id AS target, count(*) AS n FROM steps a JOIN steps b ON a.pair_id = b.pair_id AND a.rank = b.rank AND b.position = a.position + 1 GROUP BY ALL"),
    "path_summary_text": _paths(
        """SELECT pair_id, CASE WHEN count = 0 THEN 'No paths found' ELSE concat('Found ', count, CASE WHEN count = 1 THEN ' path' ELSE ' paths' END, ' of degree ', length, '.',
 CASE WHEN count > least(count, 8) THEN concat(' A random sample of ', least(count, 8), ' paths is shown below.') ELSE '' END) END AS text FROM total"""
    ),
    "page_urls": _with("SELECT page_id, 'https://en.wikipedia.org/wiki/' || title AS url FROM fx_page"),
    "title_fold_match": f"WITH {_TITLES} SELECT q.query, t.page_id, t.title FROM t JOIN (SELECT DISTINCT upper(title) AS query FROM t) q ON lower(strip_accents(t.title)) = lower(strip_accents(q.query))",
    "title_suggest": f"WITH {_TITLES} SELECT page_id, title FROM t WHERE starts_with(lower(strip_accents(title)), 'en') ORDER BY CASE WHEN lower(strip_accents(title)) = 'en' THEN 0 ELSE 1 END, length(title), title, page_id LIMIT 5",
    "name_parse": f"WITH {_NAMES} SELECT * FROM parsed",
    "dump_name_parse": f"WITH {_NAMES} SELECT name, nullif(regexp_extract(name, {_DUMP}, 1), '') AS language_code, nullif(regexp_extract(name, {_DUMP}, 2), '') AS date_code, nullif(regexp_extract(name, {_DUMP}, 3), '') AS kind FROM names",
    "catalog_newest": f"WITH {_NAMES}, {_NEWEST} SELECT * FROM newest",
    "catalog_cleanup": f"WITH {_NAMES}, {_NEWEST} SELECT name FROM parsed p JOIN newest n ON p.language_code = n.language_code AND p.date_code <> n.date_code",
    "default_language": f"WITH {_NAMES}, {_NEWEST} SELECT language_code FROM newest ORDER BY CASE {' '.join(f"WHEN contains(language_code, '{x[:2]}') THEN {i}" for i, x in enumerate(PREFERRED))} ELSE {len(PREFERRED)} END, language_code LIMIT 1",
    "random_page": _with("SELECT page_id FROM fx_page WHERE namespace = 0 ORDER BY md5('7:' || page_id), page_id LIMIT 1"),
    "link_sources_missing_page": _graph("SELECT count(DISTINCT source) AS n FROM g_links WHERE source NOT IN (SELECT page_id FROM fx_page)"),
}
