"""Queries over the failure graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweir.functions import components as C
from signalweir.operators import graph
from signalweir.registry.base import duck_stamp, query, stamp
from signalweir.registry.views import view, with_views
from signalweir.session import stored

_HEADS = ", ".join(f"'{w}'" for w in C.DESCRIPTIVE_HEADS)
_TAILS = ", ".join(f"'{w}'" for w in C.RESOURCE_TAILS)
_SEEDS = "|".join(C.SEED_COMPONENTS)
_SUFFIX = "|".join(C.COMPONENT_SUFFIXES)


def _norm(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(trim(lower({e})), '[_\\s]+', '-', 'g'), "
        "'-(?:[0-9a-f]{4,10}|[0-9]+)$', ''), '-+$', '')"
    )


def _plausible(e: str) -> str:
    n = _norm(e)
    return (
        f"(length({n}) >= 3 AND split_part({n}, '-', 1) NOT IN ({_HEADS}) AND "
        f"NOT (contains({n}, '-') AND regexp_extract({n}, '([^-]*)$', 1) IN ({_TAILS})))"
    )


# RE2 has no lookbehind, but its \b is the ASCII word edge the names are defined by
_NAMED_ALL = f"""list_concat(list_filter(['{"', '".join(C.SEED_COMPONENTS)}'], lambda s: list_contains(regexp_extract_all(lower({{t}}), '\\b({_SEEDS})\\b', 1), s)),
  list_transform(regexp_extract_all(lower({{t}}), '\\b([a-z][a-z0-9]*(?:[-_][a-z0-9]+)*?[-_](?:{_SUFFIX}))\\b', 1), lambda m: {_norm('m')}))"""
_NAMED = f"list_distinct({_NAMED_ALL})"

_CASCADE = f"""base AS (SELECT *, {_norm('primary_component')} AS primary_name FROM v_findings),
named AS (SELECT report_id, unnest(list_distinct(list_concat([{_norm('hypothesis_component')}], {_NAMED.replace('{t}', 'reasoning')}))) AS n FROM base),
down AS (SELECT b.report_id, b.tenant_id, b.primary_name, b.created_at, n.n FROM base b JOIN named n ON n.report_id = b.report_id
  WHERE n.n <> '' AND n.n <> b.primary_name AND {_plausible('n.n')} AND contains(regexp_replace(lower(b.evidence_text), '[_\\s]+', '-', 'g'), {_norm('n.n')})),
prim AS (SELECT * FROM base WHERE {_plausible('primary_name')}),
nodes AS (SELECT tenant_id, component, count(*) AS incident_count FROM (SELECT tenant_id, primary_name AS component FROM prim
  UNION ALL SELECT tenant_id, n FROM down WHERE {_plausible('primary_name')}) GROUP BY 1, 2),
edges AS (SELECT tenant_id, primary_name AS from_node, n AS to_node, count(*) AS occurrence_count, max(created_at) AS last_seen_at FROM down
  WHERE {_plausible('primary_name')} GROUP BY 1, 2, 3)"""


def _cascades(spark, sf_dir, learned=None):
    rows = view(spark, sf_dir, "v_findings").withColumns(
        {"hypothesis_components": F.array("hypothesis_component"), "reasoning": F.array("reasoning")}
    )
    return graph.cascades(rows, learned)


@query(
    "g1_report_edges",
    with_views(["v_findings"], _CASCADE + " SELECT tenant_id, from_node, to_node, occurrence_count FROM edges"),
)
def report_edges(spark, sf_dir):
    """The same findings, read back out of report payloads."""
    found = view(spark, sf_dir, "v_findings").withColumn("incident_id", F.col("report_id"))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("primary_component").alias("primaryFailingComponent")).alias("incidentFingerprint"),
            F.array(F.struct(F.col("reasoning").alias("observation"))).alias("diagnosticReasoning"),
        )
    )
    reports = found.select("report_id", "incident_id", "tenant_id", payload.alias("ai_payload"), "created_at")
    named = found.select("incident_id", F.col("hypothesis_component").alias("component"))
    texts = found.select("incident_id", F.col("evidence_text").alias("text"))
    edges = graph.build_graph(graph.cascades(graph.report_findings(reports, named, texts)))[1]
    return edges.select("tenant_id", "from_node", "to_node", "occurrence_count")


def _parts(spark, sf_dir, kept=lambda df: df):
    """Nodes and edges of the part graph; what reads them more than once has the edges kept."""
    edges = kept(view(spark, sf_dir, "v_edges"))
    ends = edges.select("tenant_id", F.col("from_node").alias("component")).unionByName(
        edges.select("tenant_id", F.col("to_node").alias("component"))
    )
    nodes = ends.groupBy("tenant_id", "component").agg(F.count("*").alias("incident_count"))
    return nodes, edges


_PARTS = """ends AS (SELECT tenant_id, from_node AS component FROM v_edges UNION ALL SELECT tenant_id, to_node FROM v_edges),
nodes AS (SELECT tenant_id, component, count(*) AS incident_count FROM ends GROUP BY 1, 2)"""


@query(
    "f29_component_names",
    with_views(
        ["v_findings"],
        f"""SELECT report_id, {_norm('hypothesis_component')} AS name, {_plausible('hypothesis_component')} AS plausible,
  contains(regexp_replace(lower(evidence_text), '[_\\s]+', '-', 'g'), {_norm('hypothesis_component')}) AS grounded FROM v_findings""",
    ),
)
def component_names(spark, sf_dir):
    c = F.col("hypothesis_component")
    return view(spark, sf_dir, "v_findings").select(
        "report_id", C.normalize_component(c).alias("name"), C.is_plausible(c).alias("plausible"),
        C.is_grounded(c, F.col("evidence_text")).alias("grounded"),
    )


def _texts(spark, sf_dir):
    text = F.concat_ws(" ", "primary_component", "reasoning", "evidence_text")
    return view(spark, sf_dir, "v_findings").select(F.col("report_id").alias("text_id"), "tenant_id", text.alias("text"))


_TEXTS = f"""txt AS (SELECT report_id AS text_id, tenant_id, concat_ws(' ', primary_component, reasoning, evidence_text) AS text FROM v_findings),
named_all AS (SELECT *, {_NAMED_ALL.replace('{t}', 'text')} AS spoken FROM txt),
found AS (SELECT text_id, tenant_id, text, component, list_position(spoken, component) AS pos FROM (SELECT *, unnest(list_distinct(spoken)) AS component FROM named_all))"""


@query("g5_components_in_text", with_views(["v_findings"], _TEXTS + " SELECT text_id, component FROM found"))
def components_in_text(spark, sf_dir):
    return graph.components_in_text(_texts(spark, sf_dir)).select("text_id", "component")


@query(
    "j10_learned_components",
    with_views(
        ["v_findings"],
        _TEXTS
        + f""", learned AS (SELECT DISTINCT tenant_id, {_norm('hypothesis_component')} AS name FROM v_findings)
SELECT text_id, component FROM found UNION SELECT t.text_id, l.name FROM txt t JOIN learned l ON l.tenant_id = t.tenant_id AND contains(lower(t.text), l.name)""",
    ),
)
def learned_components(spark, sf_dir):
    learned = view(spark, sf_dir, "v_findings").select("tenant_id", F.col("hypothesis_component").alias("name"))
    return graph.components_in_text(_texts(spark, sf_dir), learned).select("text_id", "component")


@query(
    "a16_primary_component",
    with_views(
        ["v_findings"],
        _TEXTS
        + """, cnt AS (SELECT text_id, component, pos, len(regexp_extract_all(lower(text), concat('\\b', component, '\\b'))) AS mentions FROM found)
SELECT text_id, component, mentions FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY mentions DESC, pos) AS rn FROM cnt WHERE mentions > 0) WHERE rn = 1""",
    ),
)
def primary_component(spark, sf_dir):
    return graph.primary_component(_texts(spark, sf_dir))


@query("a8_graph_nodes", with_views(["v_findings"], _CASCADE + " SELECT * FROM nodes"))
def graph_nodes(spark, sf_dir):
    return graph.build_graph(_cascades(spark, sf_dir))[0].select("tenant_id", "component", "incident_count")


@query(
    "a9_graph_edges",
    with_views(
        ["v_findings"],
        _CASCADE + f" SELECT tenant_id, from_node, to_node, occurrence_count, {duck_stamp('last_seen_at')} AS last_seen_at FROM edges",
    ),
)
def graph_edges(spark, sf_dir):
    edges = graph.build_graph(_cascades(spark, sf_dir))[1]
    return edges.select("tenant_id", "from_node", "to_node", "occurrence_count", stamp("last_seen_at").alias("last_seen_at"))


@query(
    "g1_graph_with_learned_names",
    with_views(
        ["v_findings"],
        _CASCADE
        + f""", known AS (SELECT DISTINCT tenant_id, {_norm('hypothesis_component')} AS name FROM v_findings),
more AS (SELECT b.report_id, b.tenant_id, b.primary_name, k.name AS n FROM prim b JOIN known k ON k.tenant_id = b.tenant_id AND contains(lower(b.reasoning), k.name)
  WHERE k.name <> b.primary_name AND {_plausible('k.name')} AND contains(regexp_replace(lower(b.evidence_text), '[_\\s]+', '-', 'g'), {_norm('k.name')}))
SELECT tenant_id, primary_name AS from_node, n AS to_node, count(*) AS occurrence_count FROM (
  SELECT report_id, tenant_id, primary_name, n FROM down WHERE {_plausible('primary_name')} UNION SELECT * FROM more) GROUP BY 1, 2, 3""",
    ),
)
def graph_with_learned(spark, sf_dir):
    learned = view(spark, sf_dir, "v_findings").select("tenant_id", F.col("hypothesis_component").alias("name"))
    edges = graph.build_graph(_cascades(spark, sf_dir, learned))[1]
    return edges.select("tenant_id", "from_node", "to_node", "occurrence_count")


@query(
    "g2_graph_context",
    with_views(
        ["v_edges"],
        _PARTS
        + f""" SELECT e.tenant_id, e.from_node AS component, s.incident_count AS total_incidents, coalesce(CAST(t.component AS VARCHAR), 'unknown') AS downstream,
  e.occurrence_count, {duck_stamp('e.last_seen_at')} AS last_seen_at FROM v_edges e JOIN nodes s ON s.tenant_id = e.tenant_id AND s.component = e.from_node
  LEFT JOIN nodes t ON t.tenant_id = e.tenant_id AND t.component = e.to_node""",
    ),
)
def context(spark, sf_dir):
    return graph.graph_context(*_parts(spark, sf_dir)).withColumn("last_seen_at", stamp("last_seen_at"))


@query(
    "g4_best_graph_context",
    with_views(
        ["v_findings"],
        _CASCADE
        + ", "
        + _TEXTS
        + """, sizes AS (SELECT tenant_id, from_node AS component, count(*) AS edge_count FROM edges GROUP BY 1, 2),
hit AS (SELECT f.text_id, f.tenant_id, f.component, f.pos, s.edge_count, n.incident_count AS total_incidents FROM found f
  JOIN sizes s ON s.tenant_id = f.tenant_id AND s.component = f.component JOIN nodes n ON n.tenant_id = f.tenant_id AND n.component = f.component)
SELECT text_id, tenant_id, component, edge_count, total_incidents FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY edge_count DESC, pos) AS rn FROM hit) WHERE rn = 1""",
    ),
)
def best_context(spark, sf_dir):
    nodes, edges = graph.build_graph(_cascades(spark, sf_dir))
    return graph.best_graph_context(_texts(spark, sf_dir), graph.graph_context(nodes, edges))


def _walk() -> str:
    parts = [
        """tot AS (SELECT tenant_id, from_node, sum(occurrence_count) AS total FROM v_edges GROUP BY 1, 2),
roots AS (SELECT tenant_id, from_node AS root FROM tot),
w0 AS (SELECT tenant_id, root, root AS node, CAST([] AS BIGINT[]) AS path, NULL::BIGINT AS parent, NULL::BIGINT AS occ, CAST(1 AS DOUBLE) AS strength, 0 AS wave FROM roots)"""
    ]
    for n in range(1, 5):
        seen = " UNION ALL ".join(f"SELECT tenant_id, root, node FROM w{i}" for i in range(n))
        parts.append(
            f"""seen{n} AS ({seen}),
r{n} AS (SELECT f.tenant_id, f.root, e.to_node AS node, list_append(f.path, e.to_node) AS path, f.node AS parent, e.occurrence_count AS occ,
  f.strength * least(e.occurrence_count / 10, 1.0) * CAST(0.85 AS DOUBLE) AS strength, {n} AS wave FROM w{n - 1} f JOIN v_edges e ON e.tenant_id = f.tenant_id AND e.from_node = f.node
  WHERE NOT EXISTS (SELECT 1 FROM seen{n} s WHERE s.tenant_id = f.tenant_id AND s.root = f.root AND s.node = e.to_node)),
w{n} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, root, node ORDER BY path) AS rn FROM r{n}) WHERE rn = 1)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(1, 5))
    return (
        ",\n".join(parts)
        + f""", cascade AS ({union}) SELECT tenant_id, root, node AS component, wave, CASE WHEN parent = root THEN root END AS via_component,
  occ AS occurrence_count, CAST(floor(strength * 100 + 0.5) AS BIGINT) AS estimated_probability FROM cascade"""
    )


@query("g3_blast_radius", with_views(["v_edges"], _walk()))
def blast(spark, sf_dir):
    nodes, edges = _parts(spark, sf_dir, stored)
    return graph.blast_radius(nodes, edges, edges.select("tenant_id", F.col("from_node").alias("root")).distinct())


@query(
    "a23_graph_stats",
    with_views(
        ["v_edges"],
        _PARTS
        + """ SELECT tenant_id, count(*) AS node_count, (SELECT count(*) FROM v_edges e WHERE e.tenant_id = nodes.tenant_id) AS edge_count FROM nodes GROUP BY tenant_id""",
    ),
)
def stats(spark, sf_dir):
    return graph.graph_stats(*_parts(spark, sf_dir))
