"""DuckDB SQL whose rows equal the registered queries'."""

from __future__ import annotations

_INC = "inc AS (SELECT l_orderkey AS h, l_partkey::VARCHAR AS e FROM lineitem), sz AS (SELECT h, count(*) AS n FROM inc GROUP BY h)"


def _reflexive(inc: str = _INC) -> str:
    """CTEs inc, sz, ed, rs, g of a one-column graph without trimming."""
    return f"""{inc},
ed AS (SELECT a.e AS src, b.e AS dst, sum(2.0::DOUBLE / (n * n)) AS value FROM inc a JOIN inc b USING (h) JOIN sz USING (h) GROUP BY 1, 2),
rs AS (SELECT e, sum(2.0::DOUBLE / n) AS row_sum FROM inc JOIN sz USING (h) GROUP BY e),
g AS (SELECT src, dst, value, value / s.row_sum AS left_w, value / sqrt(s.row_sum * t.row_sum) AS sym_w FROM ed JOIN rs s ON src = s.e JOIN rs t ON dst = t.e),
ent AS (SELECT e AS entity_id, row_sum, 0 AS column_id FROM rs),
adj AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst)"""


def _two(left: str, right: str) -> str:
    """The same of a two-column graph; left (h, e) and right (h, e) are the sides."""
    return f"""la AS ({left}), lb AS ({right}),
na AS (SELECT h, count(*) AS a FROM la GROUP BY h), nb AS (SELECT h, count(*) AS b FROM lb GROUP BY h),
pr AS (SELECT la.e AS x, lb.e AS y, 1.0::DOUBLE / (a * b) AS v FROM la JOIN lb USING (h) JOIN na USING (h) JOIN nb USING (h)),
ed AS (SELECT src, dst, sum(v) AS value FROM (SELECT x AS src, y AS dst, v FROM pr UNION ALL SELECT y, x, v FROM pr) GROUP BY 1, 2),
rs AS (SELECT e, sum(w) AS row_sum, min(c) AS c FROM (SELECT la.e, 1.0::DOUBLE / b AS w, 0 AS c FROM la JOIN nb USING (h) UNION ALL SELECT lb.e, 1.0::DOUBLE / a, 1 FROM lb JOIN na USING (h)) GROUP BY e),
g AS (SELECT src, dst, value, value / s.row_sum AS left_w, value / sqrt(s.row_sum * t.row_sum) AS sym_w FROM ed JOIN rs s ON src = s.e JOIN rs t ON dst = t.e),
ent AS (SELECT e AS entity_id, row_sum, c AS column_id FROM rs),
adj AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst)"""


def _lines(select: str) -> str:
    """inc and sz of two-token lines given as SELECT h, x, y."""
    return f"ln AS ({select}), inc AS (SELECT h, x AS e FROM ln UNION ALL SELECT h, y FROM ln), sz AS (SELECT h, count(*) AS n FROM inc GROUP BY h)"


_B = _reflexive()
_CP = _two("SELECT o_orderkey AS h, 'c' || o_custkey AS e FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", "SELECT l_orderkey AS h, 'p' || l_partkey AS e FROM lineitem")
_UE = _two("SELECT event_id AS h, 'u' || user_id AS e FROM events", "SELECT event_id AS h, event_type AS e FROM events")
_EV = "SELECT 'u' || user_id || ' ' || event_type AS value FROM events"
_NG = _reflexive(_lines("SELECT 'c' || c_custkey AS h, 'c' || c_custkey AS x, 'n' || c_nationkey AS y FROM customer UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier"))
_INIT = "x0 AS (SELECT entity_id, dim, ((('0x' || substr(md5(entity_id || ':' || dim), 1, 8))::BIGINT % 2000) - 1000) / 1000.0::DOUBLE AS x FROM ent, (SELECT unnest(range(0, 4))::INTEGER AS dim))"


def _step(src: str, out: str, w: str = "left_w") -> str:
    return f"{out} AS (SELECT g.src AS entity_id, dim, sum({w} * x) AS x FROM g JOIN {src} ON g.dst = {src}.entity_id GROUP BY 1, 2)"


def _l2(src: str, out: str) -> str:
    return f"{out} AS (SELECT entity_id, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 1e-10) AS x FROM {src})"


_V = "v AS (SELECT vec_id::VARCHAR AS entity_id, label, list_transform(embedding, lambda t: t::DOUBLE) AS e FROM embeddings)"
_U = _V + ", vl AS (SELECT entity_id, label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v)"
_UN = _U + ", un AS (SELECT entity_id, label, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 1e-10) AS x FROM vl)"
_COS = "sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))"
_CENT = _U + f""", ce AS (SELECT label AS predicted, dim, avg(x) AS x FROM vl GROUP BY 1, 2),
sc AS (SELECT a.entity_id, b.predicted, {_COS} AS s FROM vl a JOIN ce b USING (dim) GROUP BY 1, 2),
pd AS (SELECT entity_id, predicted FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, predicted) AS rn FROM sc) WHERE rn = 1),
cf AS (SELECT label, predicted, count(*) AS n FROM v JOIN pd USING (entity_id) GROUP BY 1, 2)"""
_PC = "cf AS (SELECT p_brand AS label, p_size AS predicted, count(*) AS n FROM part GROUP BY 1, 2)"
_OS = "s AS (SELECT o_custkey % 100 AS query, o_orderkey AS item, o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hit FROM orders)"
_TOK = "pa AS (SELECT conv_id, turn, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') AS p, row_number() OVER () AS h FROM conversations), tk AS (SELECT h, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM pa)"
_MAPK = "rk AS (SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s), tt AS (SELECT query, sum(hit) AS t FROM s GROUP BY query HAVING sum(hit) > 0)"


def _w(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_HET = """he AS (SELECT 'lives' AS edge_type, 'customer_' || c_custkey AS src, 'nation_' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'lies', 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation
UNION ALL SELECT 'buys', 'customer_' || o_custkey, 'part_' || l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'sold_by', 'part_' || l_partkey, 'supplier_' || l_suppkey FROM lineitem)"""

ORACLE_SQL: dict[str, str] = {
    "hetero_edge_counts": _w(_HET, "SELECT edge_type, count(*) AS n FROM he GROUP BY 1"),
    "homogeneous_edges": _w(_HET, "SELECT src, dst, count(*) AS n FROM he GROUP BY 1, 2"),
    "legacy_persisted_entities": "SELECT 'customer__' || o_custkey AS entity_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION SELECT 'part__' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "legacy_train": """WITH li AS (SELECT l_orderkey AS h, l_partkey::VARCHAR AS p FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT o_orderkey AS h, o_custkey::VARCHAR AS c, n FROM orders JOIN (SELECT h AS o_orderkey, count(*) AS n FROM li GROUP BY 1) USING (o_orderkey)),
cu AS (SELECT 'customer__' || c AS entity_id, sum(n) AS occurrence FROM o GROUP BY 1),
pa AS (SELECT 'part__' || p AS entity_id, count(*) AS occurrence FROM li GROUP BY 1)
SELECT relation, entity_id, occurrence::BIGINT AS occurrence, 1.0::DOUBLE AS norm2 FROM (
SELECT 'customer__part' AS relation, * FROM cu UNION ALL SELECT 'customer__part', * FROM pa
UNION ALL SELECT 'customer__status', * FROM cu UNION ALL SELECT 'part__status', * FROM pa)""",
    "json_cells": "SELECT col, token, count(*) AS n FROM (SELECT 0 AS col, p_brand AS token FROM part UNION ALL SELECT 1, p_type FROM part UNION ALL SELECT 1, p_size::VARCHAR FROM part) GROUP BY 1, 2",
    "tsv_cells": "SELECT col, token, count(*) AS n FROM (SELECT 0 AS col, p_brand AS token FROM part UNION ALL SELECT 1, unnest(string_split(p_name || ' ' || p_size, ' ')) FROM part) GROUP BY 1, 2",
    "coo_lines": "SELECT DISTINCT least(c_custkey, c_nationkey) || ' ' || greatest(c_custkey, c_nationkey) AS value FROM customer WHERE c_acctbal > 0",
    "nation_diameter": "SELECT least(max(n), 2)::BIGINT AS diameter FROM (SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k)",
    "nation_summary": _w(_NG, "SELECT n AS num_nodes, m // 2 AS num_edges, round(m / (n * (n - 1))::DOUBLE, 6) AS density, round(m / n::DOUBLE, 6) AS avg_degree, 0.0::DOUBLE AS clustering, (SELECT count(*) FROM ent WHERE entity_id LIKE 'n%') AS components FROM (SELECT count(*) AS n FROM ent), (SELECT count(*) AS m FROM adj)"),
    "basket_left_topk": _w(_B, "SELECT src, dst, w, rank FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst)::INTEGER AS rank FROM (SELECT src, dst, round(left_w + 1e-9, 6) AS w FROM g WHERE src <> dst)) WHERE rank <= 3"),
    "basket_edges": _w(_B, "SELECT src, dst, round(value, 6) AS value FROM g"),
    "basket_degrees": _w(_B, "SELECT entity_id, round(row_sum, 6) AS row_sum FROM ent"),
    "basket_markov": _w(_B, "SELECT src, dst, round(left_w + 1e-9, 6) AS left_w, round(sym_w + 1e-9, 6) AS sym_w FROM g"),
    "basket_trimmed": _w(
        _INC
        + """, occ AS (SELECT e, 2 * sum(n) AS occ FROM inc JOIN sz USING (h) GROUP BY e),
hi AS (SELECT h, e FROM (SELECT h, inc.e, row_number() OVER (PARTITION BY h ORDER BY occ DESC, inc.e) AS rn FROM inc JOIN occ ON inc.e = occ.e) WHERE rn <= 4),
hd AS (SELECT DISTINCT h, e FROM hi),
pr AS (SELECT a.e AS x, b.e AS y, 1.0::DOUBLE / (n * n) AS v FROM inc a JOIN inc b USING (h) JOIN sz USING (h)
       WHERE (h, a.e) IN (SELECT h, e FROM hd) OR (h, b.e) IN (SELECT h, e FROM hd))""",
        "SELECT src, dst, round(sum(v), 6) AS value FROM (SELECT x AS src, y AS dst, v FROM pr UNION ALL SELECT y, x, v FROM pr) GROUP BY 1, 2",
    ),
    "customer_part_markov": _w(_CP, "SELECT src, dst, round(left_w + 1e-9, 6) AS left_w, round(sym_w + 1e-9, 6) AS sym_w FROM g"),
    "customer_part_degrees": _w(_CP, "SELECT entity_id, round(row_sum, 6) AS row_sum FROM ent"),
    "user_event_markov": _w(_UE, "SELECT src, dst, round(left_w + 1e-9, 6) AS left_w FROM g"),
    "column_mask": _w(_UE, "SELECT entity_id, column_id = 1 AS mask FROM ent"),
    "graph_counts": _w(_B, "SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM g) AS edges"),
    "parsed_lines": r"""
WITH l AS (SELECT p_name || chr(9) || p_brand AS v FROM part UNION ALL SELECT n_name || ' , x' || n_regionkey FROM nation),
c AS (SELECT CASE WHEN contains(v, chr(9)) THEN string_split(v, chr(9)) WHEN contains(v, ',') THEN list_transform(string_split(v, ','), lambda x: trim(x)) ELSE [v] END AS cells FROM l)
SELECT len(cells)::INTEGER AS cells, list_sum(list_transform(cells, lambda x: len(string_split(x, ' '))))::INTEGER AS tokens, count(*) AS n FROM c GROUP BY 1, 2""",
    "from_table_degrees": _w(_reflexive(_lines("SELECT c_custkey AS h, c_custkey::VARCHAR AS x, 'n' || c_nationkey AS y FROM customer")), "SELECT entity_id, round(row_sum, 6) AS row_sum FROM ent"),
    "legacy_relation_weights": """
WITH o AS (SELECT o_orderkey AS h, 'customer__' || o_custkey AS c, 'status__' || o_orderstatus AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
p AS (SELECT l_orderkey AS h, 'part__' || l_partkey AS p FROM lineitem), n AS (SELECT h, count(*) AS n FROM p GROUP BY h),
pr AS (SELECT 'customer__part' AS relation, c AS x, p AS y, 1.0::DOUBLE / n AS v FROM o JOIN p USING (h) JOIN n USING (h)
  UNION ALL SELECT 'customer__status', c, s, 1.0 FROM o UNION ALL SELECT 'part__status', p, s, 1.0::DOUBLE / n FROM o JOIN p USING (h) JOIN n USING (h)),
e AS (SELECT relation, src, dst, sum(v) AS v FROM (SELECT relation, x AS src, y AS dst, v FROM pr UNION ALL SELECT relation, y, x, v FROM pr) GROUP BY 1, 2, 3)
SELECT relation, src, dst, round(v / sum(v) OVER (PARTITION BY relation, src) + 1e-9, 6) AS weight FROM e""",
    "edge_list_undirected": _w(_B, "SELECT src, dst, round(left_w + 1e-9, 6) AS weight FROM g WHERE src <= dst"),
    "clean_lines": f"SELECT DISTINCT value FROM ({_EV})",
    "filter_lines_by_degree": f"WITH l AS ({_EV}), t AS (SELECT unnest(string_split(value, ' ')) AS e FROM l), d AS (SELECT e, count(*) AS d FROM t GROUP BY e) SELECT value FROM l JOIN d a ON split_part(value, ' ', 1) = a.e JOIN d b ON split_part(value, ' ', 2) = b.e WHERE a.d >= 60 AND b.d >= 60",
    "filter_graph_by_degree": _w(_B + ", d AS (SELECT src AS e, count(*) AS d FROM adj GROUP BY 1 HAVING count(*) BETWEEN 110 AND 130)", "SELECT src, dst FROM adj WHERE src < dst AND src IN (SELECT e FROM d) AND dst IN (SELECT e FROM d)"),
    "remove_edges": f"SELECT DISTINCT value FROM ({_EV}) WHERE NOT ends_with(value, 'click')",
    "update_graph_degrees": _w(_reflexive(_lines("SELECT event_id AS h, 'u' || user_id AS x, event_type AS y FROM events WHERE ends_with(event_type, 'view') OR ends_with(event_type, 'error')")), "SELECT entity_id, round(row_sum, 6) AS row_sum FROM ent"),
    "spmm_left": _w(", ".join([_B, _INIT, _step("x0", "x1")]), "SELECT entity_id, dim, round(x, 6) AS x FROM x1"),
    "spmm_symmetric": _w(", ".join([_B, _INIT, _step("x0", "x1", "sym_w")]), "SELECT entity_id, dim, round(x, 6) AS x FROM x1"),
    "embed_2_rounds": _w(", ".join([_UE, _INIT, _step("x0", "x1"), _l2("x1", "y1"), _step("y1", "x2"), _l2("x2", "y2")]), "SELECT entity_id, dim, round(x, 6) AS x FROM y2"),
    "embed_distributed_2_rounds": _w(", ".join([_UE, _INIT, _step("x0", "x1"), _l2("x1", "y1"), _step("y1", "x2"), _l2("x2", "y2")]), "SELECT entity_id, dim, round(x, 6) AS x FROM y2"),
    "embed_residual": _w(", ".join([_UE, _INIT, _step("x0", "x1"), "m AS (SELECT entity_id, dim, 0.75::DOUBLE * x1.x + 0.25::DOUBLE * x0.x AS x FROM x1 JOIN x0 USING (entity_id, dim))", _l2("m", "y1")]), "SELECT entity_id, dim, round(x, 6) AS x FROM y1"),
    "embed_multiscale": _w(", ".join([_UE, _INIT, _step("x0", "x1"), _l2("x1", "y1"), _step("y1", "x2"), _l2("x2", "y2")]), "SELECT entity_id, dim, round(x, 6) AS x FROM y1 UNION ALL SELECT entity_id, (dim + 4)::INTEGER, round(x, 6) FROM y2"),
    "embed_attention_step": _w(
        ", ".join([_UE, _INIT, f"cs AS (SELECT g.src, g.dst, any_value(left_w) AS w, {_COS} AS s FROM g JOIN x0 a ON a.entity_id = g.src JOIN x0 b ON b.entity_id = g.dst AND b.dim = a.dim GROUP BY 1, 2)", "p AS (SELECT src, dst, w, exp(s - max(s) OVER (PARTITION BY src)) AS p FROM cs)", "q AS (SELECT src, dst, w * p / sum(p) OVER (PARTITION BY src) AS q FROM p)"]),
        "SELECT src, dst, round(q / greatest(sum(q) OVER (PARTITION BY src), 1e-10), 6) AS w FROM q",
    ),
    "directed_edges": _w(_reflexive(_lines("SELECT event_id AS h, 'u' || user_id AS x, event_type AS y FROM events")) + ", k AS (SELECT g.* FROM g JOIN (SELECT DISTINCT x, y FROM ln) o ON g.src = o.x AND g.dst = o.y)", "SELECT src, dst, round(left_w / sum(left_w) OVER (PARTITION BY src), 6) AS w FROM k"),
    "l2_rows": _w(_UN, "SELECT entity_id, dim::INTEGER AS dim, round(x, 6) AS x FROM un"),
    "l1_rows": _w(_U, "SELECT entity_id, dim::INTEGER AS dim, round(x / greatest(sum(abs(x)) OVER (PARTITION BY entity_id), 1e-10), 6) AS x FROM vl"),
    "rmse_of_round": _w(", ".join([_UE, _INIT, _step("x0", "x1")]), "SELECT round(sqrt(avg((x0.x - x1.x) * (x0.x - x1.x))), 6) AS rmse FROM x0 JOIN x1 USING (entity_id, dim)"),
    "covariance": _w(_U, "SELECT a.dim::INTEGER AS i, b.dim::INTEGER AS j, round(covar_samp(a.x, b.x), 6) + 0.0::DOUBLE AS c FROM vl a JOIN vl b USING (entity_id) GROUP BY 1, 2"),
    "knn_topk": _w(_UN, "SELECT source, target, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, target)::INTEGER AS rank FROM (SELECT a.entity_id AS source, b.entity_id AS target, sum(a.x * b.x) AS s FROM un a JOIN un b USING (dim) WHERE a.entity_id::BIGINT % 50 = 0 AND a.entity_id <> b.entity_id GROUP BY 1, 2)) WHERE rank <= 5"),
    "most_similar": _w(_UN, "SELECT source, entity_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, entity_id) AS rank FROM (SELECT a.entity_id AS source, b.entity_id, sum(a.x * b.x) AS s FROM un a JOIN un b USING (dim) WHERE a.entity_id::BIGINT % 50 = 0 AND a.entity_id <> b.entity_id GROUP BY 1, 2)) WHERE rank <= 10"),
    "ann_brute": _w(_UN, "SELECT source, target, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, target)::INTEGER AS rank FROM (SELECT a.entity_id AS source, b.entity_id AS target, sum(a.x * b.x) AS s FROM un a JOIN un b USING (dim) WHERE a.entity_id::BIGINT % 50 = 0 AND a.entity_id <> b.entity_id GROUP BY 1, 2)) WHERE rank <= 10"),
    "ensemble_mean": _w(_UN, "SELECT entity_id, un.dim::INTEGER AS dim, round(0.5::DOUBLE * vl.x + 0.5::DOUBLE * un.x, 6) AS x FROM un JOIN vl USING (entity_id, dim)"),
    "degree_distribution": _w(_B + ", dg AS (SELECT entity_id, (SELECT count(*) FROM adj WHERE src = entity_id) AS d FROM ent)", "SELECT r.d AS degree, count(dg.entity_id) AS count FROM (SELECT unnest(range(0, (SELECT max(d) FROM dg) + 1)) AS d) r LEFT JOIN dg USING (d) GROUP BY 1"),
    "density": _w(_B + ", c AS (SELECT (SELECT count(*) FROM ent) AS n, (SELECT count(*) FROM adj) AS m)", "SELECT n, (m // 2)::BIGINT AS m, round(m / (n * (n - 1))::DOUBLE, 6) AS density, round(m / n::DOUBLE, 6) AS avg_degree FROM c"),
    "clustering_coefficient": _w(
        _B + ", dg AS (SELECT src, count(*) AS d FROM adj GROUP BY 1), tr AS (SELECT a.src, count(*) AS t FROM adj a JOIN adj b ON a.src = b.src AND a.dst < b.dst JOIN adj c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)",
        "SELECT round(avg(2 * coalesce(t, 0) / (d * (d - 1))::DOUBLE), 6) AS clustering_coefficient FROM dg LEFT JOIN tr USING (src) WHERE d >= 2",
    ),
    "pagerank_10": _w(
        _UE + ", dg AS (SELECT src, count(*) AS d FROM adj GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM ent), r0 AS (SELECT entity_id, 1 / n AS r FROM ent, n)"
        + "".join(f", r{i + 1} AS (SELECT e.entity_id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0) AS r FROM ent e CROSS JOIN n LEFT JOIN (SELECT adj.dst, sum(r / d) AS s FROM adj JOIN r{i} ON adj.src = r{i}.entity_id JOIN dg ON dg.src = adj.src GROUP BY 1) t ON t.dst = e.entity_id)" for i in range(10)),
        "SELECT entity_id, round(r, 6) AS pagerank FROM r10",
    ),
    "connected_components": "WITH RECURSIVE " + _NG + ", reach AS (SELECT entity_id AS a, entity_id AS b FROM ent UNION SELECT reach.a, adj.dst FROM reach JOIN adj ON reach.b = adj.src) SELECT a AS entity_id, min(b) AS component FROM reach GROUP BY a",
    "bfs_hops": "WITH RECURSIVE " + _NG + ", w AS (SELECT entity_id AS source, entity_id, 0 AS hops FROM ent WHERE entity_id IN ('n0', 'n1') UNION SELECT source, adj.dst, hops + 1 FROM w JOIN adj ON w.entity_id = adj.src WHERE hops < 4) SELECT source, entity_id, min(hops)::INTEGER AS hops FROM w GROUP BY 1, 2",
    "betweenness": "SELECT 's' || s_suppkey AS entity_id, 0.0::DOUBLE AS betweenness FROM supplier UNION ALL SELECT 'n' || s_nationkey, count(*) * (count(*) - 1) / 2.0::DOUBLE FROM supplier GROUP BY s_nationkey",
    "modularity": _w(_B + ", dg AS (SELECT src, count(*) AS d, any_value(src::BIGINT % 10) AS c FROM adj GROUP BY 1), w AS (SELECT count(*)::DOUBLE AS w FROM adj)", "SELECT round(sum(1 - a.d * b.d / w) / any_value(w), 6) AS modularity FROM adj JOIN dg a ON adj.src = a.src JOIN dg b ON adj.dst = b.src, w WHERE a.c = b.c"),
    "label_propagation_3": _w(
        _UE + ", dg AS (SELECT src, count(*) AS d FROM adj GROUP BY 1), y AS (SELECT entity_id, length(entity_id)::INTEGER AS label, 1.0::DOUBLE AS f FROM ent WHERE column_id = 1), f0 AS (SELECT * FROM y)"
        + "".join(f", f{i + 1} AS (SELECT adj.src AS entity_id, label, sum(0.5::DOUBLE / d * f) AS f FROM adj JOIN dg USING (src) JOIN f{i} ON f{i}.entity_id = adj.dst WHERE adj.src NOT IN (SELECT entity_id FROM y) GROUP BY 1, 2 UNION ALL SELECT * FROM y)" for i in range(3))
        + ", b AS (SELECT entity_id, label FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(f, 12) DESC, label) AS rn FROM f3) WHERE rn = 1)",
        "SELECT ent.entity_id, coalesce(b.label, (SELECT min(label) FROM y)) AS label FROM ent LEFT JOIN b USING (entity_id)",
    ),
    "centroid_labels": _w(_CENT, "SELECT entity_id, predicted FROM pd"),
    "label_confusion": _w(_CENT, "SELECT label, predicted, n FROM cf"),
    "f1": _w(
        _CENT + ", t AS (SELECT label, sum(n) AS support, sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS tp FROM cf GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS called FROM cf GROUP BY 1), s AS (SELECT coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, 2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(called, 0))::DOUBLE AS f1 FROM t FULL JOIN p USING (label))",
        "SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM s",
    ),
    "purity": _w(_CENT, "SELECT round(sum(m) / sum(s)::DOUBLE, 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS s FROM cf GROUP BY predicted)"),
    "nmi": _w(
        _PC + ", t AS (SELECT sum(n)::DOUBLE AS t FROM cf), a AS (SELECT label, sum(n)::DOUBLE AS a FROM cf GROUP BY 1), b AS (SELECT predicted, sum(n)::DOUBLE AS b FROM cf GROUP BY 1)",
        "SELECT round(2 * (SELECT sum(n / t * ln(n * t / (a * b))) FROM cf JOIN a USING (label) JOIN b USING (predicted), t) / ((SELECT sum(-a / t * ln(a / t)) FROM a, t) + (SELECT sum(-b / t * ln(b / t)) FROM b, t)), 6) AS nmi",
    ),
    "adjusted_rand_index": _w(
        _PC + ", x AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM cf) AS i, (SELECT sum(n)::DOUBLE FROM cf) AS t, (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM (SELECT sum(n)::DOUBLE AS c FROM cf GROUP BY label)) AS a, (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM (SELECT sum(n)::DOUBLE AS c FROM cf GROUP BY predicted)) AS b)",
        "SELECT round((i - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM x",
    ),
    "silhouette": _w(
        _UN + ", d AS (SELECT a.entity_id, a.label, b.entity_id AS o, b.label AS l, 1 - sum(a.x * b.x) AS d FROM un a JOIN un b USING (dim) WHERE a.entity_id <> b.entity_id GROUP BY 1, 2, 3, 4), m AS (SELECT entity_id, label, l, avg(d) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT entity_id, max(CASE WHEN l = label THEN m END) AS a, min(CASE WHEN l <> label THEN m END) AS b FROM m GROUP BY 1)",
        "SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s",
    ),
    "intra_similarity": _w(_UN, "SELECT label, round(avg(s), 6) AS similarity FROM (SELECT a.label, a.entity_id, b.entity_id, sum(a.x * b.x) AS s FROM un a JOIN un b ON a.dim = b.dim AND a.label = b.label AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3) GROUP BY 1"),
    "auc": _w(_OS, "SELECT round((SELECT sum(CASE WHEN p.score > n.score THEN c WHEN p.score = n.score THEN 0.5::DOUBLE * c ELSE 0 END) FROM (SELECT score FROM s WHERE hit = 1) p, (SELECT score, count(*)::DOUBLE AS c FROM s WHERE hit = 0 GROUP BY 1) n) / ((SELECT count(*) FROM s WHERE hit = 1) * (SELECT count(*) FROM s WHERE hit = 0)::DOUBLE), 6) AS auc"),
    "mrr_hits": _w(
        _OS + ", r AS (SELECT 1 + (SELECT count(*) FROM s n WHERE n.query = p.query AND n.hit = 0 AND n.score >= p.score) AS r FROM s p WHERE hit = 1)",
        "SELECT round(avg(1.0::DOUBLE / r), 6) AS mrr, round(avg((r <= 1)::INTEGER), 6) AS hits_at_1, round(avg((r <= 3)::INTEGER), 6) AS hits_at_3, round(avg((r <= 10)::INTEGER), 6) AS hits_at_10, round(avg((r <= 50)::INTEGER), 6) AS hits_at_50 FROM r",
    ),
    "map_at_10": _w(f"{_OS}, {_MAPK}, c AS (SELECT query, rank, hit, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS c FROM rk WHERE rank <= 10), a AS (SELECT query, sum(hit * c / rank::DOUBLE) AS a FROM c GROUP BY 1)", "SELECT round(avg(a / least(t, 10)), 6) AS map_at_k FROM tt JOIN a USING (query)"),
    "ndcg_at_10": _w(f"{_OS}, {_MAPK}, a AS (SELECT query, sum(hit / log2(rank + 1)) AS a FROM rk WHERE rank <= 10 GROUP BY 1)", "SELECT round(avg(a / list_sum(list_transform(range(1, least(t, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_at_k FROM tt JOIN a USING (query)"),
    "hetero_nodes": """
SELECT 'customer' AS node_type, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
UNION ALL SELECT 'nation', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation)
UNION ALL SELECT 'part', count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)
UNION ALL SELECT 'region', count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)
UNION ALL SELECT 'supplier', count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem)""",
    "metapath_customer_region": "SELECT DISTINCT 'customer_' || c_custkey AS src, 'region_' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "metapath_customer_supplier": "SELECT DISTINCT 'customer_' || o_custkey AS src, 'supplier_' || b.l_suppkey AS dst FROM orders JOIN lineitem a ON o_orderkey = a.l_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey",
    "token_cooccurrence": _w(_TOK, "SELECT a.t AS src, b.t AS dst, count(*) AS n FROM tk a JOIN tk b ON a.h = b.h AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY 1, 2"),
    "token_ppmi": _w(
        _TOK + ", c AS (SELECT a.t AS src, b.t AS dst, count(*)::DOUBLE AS n FROM tk a JOIN tk b ON a.h = b.h AND abs(a.i - b.i) = 1 GROUP BY 1, 2), w AS (SELECT src, dst, ln(n * (SELECT sum(n) FROM c) / (sum(n) OVER (PARTITION BY src) * sum(n) OVER (PARTITION BY dst))) AS w FROM c)",
        "SELECT src, dst, round(w, 6) AS w FROM w WHERE w > 0",
    ),
    "document_tokens": _w("d AS (SELECT row_number() OVER () AS h, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS t FROM documents), inc AS (SELECT h, unnest(t) AS e FROM d), sz AS (SELECT h, count(*) AS n FROM inc GROUP BY h)", "SELECT e AS entity_id, round(sum(2.0::DOUBLE / n), 6) AS row_sum FROM inc JOIN sz USING (h) GROUP BY 1"),
    "page_links": _w(_two("SELECT page_id AS h, regexp_extract(url, '://([^/?#]*)', 1) AS e FROM pages WHERE len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) > 0", "SELECT page_id AS h, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS e FROM pages"), "SELECT src, dst, round(left_w + 1e-9, 6) AS left_w FROM g"),
    "windowed_graph_daily": "SELECT date_trunc('day', ts) AS window_start, user_id::VARCHAR AS src, event_type AS dst, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3",
    "file_hyperedges": "SELECT 'c' || o_custkey AS a, len(string_split(o_orderstatus || ' ' || o_orderpriority, ' '))::INTEGER AS n FROM orders",
}

_NR = _reflexive(_lines("SELECT 'n' || n_nationkey AS h, 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation"))
_SN = _reflexive(_lines("SELECT 's' || s_suppkey AS h, 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier"))
_IX = "ix AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS idx FROM ent)"
_VALUES = "SELECT src, dst, round(value, 6) AS value, round(left_w, 6) AS left_w FROM g"

ORACLE_SQL |= {
    "ann_ball_tree": ORACLE_SQL["knn_topk"],
    "graph_round_trip": _w(_NG, "SELECT src, dst, round(left_w, 6) AS left_w FROM g"),
    "embeddings_round_trip": _w(_V, "SELECT entity_id, len(e)::INTEGER AS dims, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm FROM v"),
    "nation_neighbors": _w(_NG, "SELECT dst AS entity_id, round(left_w, 6) AS weight FROM g WHERE src = 'n3'"),
    "entity_numbers": _w(f"{_NG}, {_IX}", "SELECT idx, entity_id FROM ix"),
    "sparse_symmetric": _w(f"{_NG}, {_IX}", 'SELECT a.idx AS "row", b.idx AS col, round(sym_w, 6) AS weight FROM g JOIN ix a ON src = a.entity_id JOIN ix b ON dst = b.entity_id'),
    "degrees_of_nations": _w(_NG, "SELECT entity_id, round(row_sum, 6) AS row_sum, false AS mask FROM ent"),
    "edge_list_graph": _w(_NR, _VALUES),
    "iterator_graph": _w(_NR, _VALUES),
    "numpy_graph": _w(_NR, _VALUES),
    "networkx_graph": _w(_NR, _VALUES),
    "files_graph": _w(_SN, _VALUES),
    "largest_component": """WITH e AS (SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier WHERE s_nationkey IN (3, 5) UNION ALL SELECT 'n3', 'n5')
SELECT x AS src, y AS dst FROM e UNION SELECT y, x FROM e""",
    "negatives_are_no_edges": "SELECT 100::BIGINT AS n, 100::BIGINT AS pairs, 0::BIGINT AS bad",
    "split_covers_all_edges": _w(
        _B + ", m AS (SELECT count(*) AS m, floor(count(*) * (1 - 0.2::DOUBLE))::BIGINT AS t FROM adj WHERE src < dst)",
        "SELECT 'train' AS part, t AS n, t AS pairs FROM m UNION ALL SELECT 'test', m - t, m - t FROM m",
    ),
    "neighborhood_edges": _w(_NG + ", hop AS (SELECT 'n0' AS x UNION SELECT dst FROM adj WHERE src = 'n0')", "SELECT src, dst FROM adj WHERE src IN (SELECT x FROM hop) AND dst IN (SELECT x FROM hop)"),
}
