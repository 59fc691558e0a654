"""The link graph of the pages: links name paths, paths name pages or the pages below them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import graphs
from quarrylens.session import table


def named(s, d):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    return table(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("node"), path.alias("path"))


def links(s, d):
    return table(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("name"))


def resolved(s, d):
    return graphs.resolve(links(s, d), named(s, d))


def reached(s, d, most_depth):
    """From the pages of the French part."""
    return graphs.reach(resolved(s, d)[0], named(s, d).where("path like '/fr/%'"), most_depth)


NORMAL = "'/' || array_to_string(list_filter(string_split({}, '/'), lambda x: x <> ''), '/')"
GRAPH = f"""paths AS (SELECT 'p' || page_id AS node, {NORMAL.format("regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')")} AS path FROM pages WHERE url IS NOT NULL),
    wanted AS (SELECT DISTINCT src, name, {NORMAL.format("name")} AS path FROM (SELECT 'p' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages)),
    above AS (SELECT node, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM paths, range(2, 20) t(i) WHERE i < len(string_split(path, '/'))),
    exact AS (SELECT path, count(*) AS n_exact, min(node) AS only_one FROM paths GROUP BY 1), below AS (SELECT path, count(*) AS n_below FROM above GROUP BY 1),
    found AS (SELECT *, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_exact > 1 THEN 'ambiguous' WHEN n_below > 0 THEN 'prefix' ELSE 'missing' END AS kind FROM wanted LEFT JOIN exact USING (path) LEFT JOIN below USING (path)),
    edges AS (SELECT DISTINCT a, b FROM (SELECT src AS a, CASE WHEN kind = 'exact' THEN only_one ELSE path END AS b FROM found WHERE kind IN ('exact', 'prefix') UNION ALL SELECT path, node FROM above WHERE path IN (SELECT path FROM found WHERE kind = 'prefix')) WHERE a <> b),
    sources AS (SELECT node FROM paths WHERE path LIKE '/fr/%')"""
REACH = GRAPH + """,
    steps AS (SELECT node, 0 AS depth FROM sources UNION SELECT b, depth + 1 FROM steps JOIN edges ON a = node WHERE depth < {depth}),
    nearest AS (SELECT node, min(depth) AS depth FROM steps GROUP BY 1)"""

QUERIES = {
    "link_notes": (
        lambda s, d: resolved(s, d)[1],
        f"WITH {GRAPH} SELECT src, name, kind, CAST(CASE kind WHEN 'ambiguous' THEN n_exact WHEN 'prefix' THEN n_below ELSE 0 END AS BIGINT) AS candidates FROM found WHERE kind <> 'exact'",
    ),
    "link_reach": (
        lambda s, d: reached(s, d, 4)[0],
        f"WITH RECURSIVE {REACH.format(depth=4)} SELECT node, depth, (SELECT min(a) FROM edges JOIN nearest p ON p.node = a WHERE b = n.node AND p.depth = n.depth - 1) AS via FROM nearest n",
    ),
    "link_depth_cut": (
        lambda s, d: reached(s, d, 1)[1],
        f"WITH RECURSIVE {REACH.format(depth=1)} SELECT a, b FROM edges JOIN nearest ON node = a WHERE depth = 1 AND b NOT IN (SELECT node FROM nearest)",
    ),
    "link_components": (
        lambda s, d: graphs.strongly_connected(resolved(s, d)[0]),
        f"""WITH RECURSIVE {GRAPH}, r AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a),
        same AS (SELECT a AS node, b AS other FROM r WHERE a = b UNION SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
        SELECT node, min(other) AS component, count(DISTINCT other) AS size FROM same GROUP BY 1 HAVING count(DISTINCT other) > 1""",
    ),
}
