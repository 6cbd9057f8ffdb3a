"""The causal failure graph: names in text, graph build, one-hop context, blast radius."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions import components as C
from signalweir.operators.matching import names_in_texts
from signalweir.scale import OrderedSlices, top_per_key
from signalweir.schemas import REPORT_PAYLOAD
from signalweir.session import settle, stored

MAX_DEPTH = 4
DECAY = 0.85


def components_in_text(texts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """text_id, tenant_id, component, seen_at (order of discovery), distinct per text.

    `learned` (tenant_id, name) are names the tenant's graph already knows.
    """
    rows = texts.select("text_id", "tenant_id", F.posexplode_outer(C.named_in_text(F.col("text"))).alias("seen_at", "component"))
    found = rows.where(F.col("component").isNotNull()).select(
        "text_id", "tenant_id", "component", F.col("seen_at").cast("bigint").alias("seen_at")
    )
    if learned is None:
        return found
    known = learned.select("tenant_id", C.normalize_component(F.col("name")).alias("name"))
    low = texts.withColumn("_low", F.lower("text"))
    extra = names_in_texts(low, known, ["text_id", "tenant_id"], "_low").select(
        "text_id", "tenant_id", F.col("name").alias("component"), F.lit(2**40).cast("bigint").alias("seen_at")
    )
    return found.unionByName(extra).groupBy("text_id", "tenant_id", "component").agg(F.min("seen_at").alias("seen_at"))


def primary_component(texts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """The most mentioned component of each text; the first found wins a tie."""
    if learned is None:  # names stand beside their text already
        rows = texts.select("text_id", "text", F.posexplode_outer(C.named_in_text(F.col("text"))).alias("seen_at", "component"))
        found = rows.where(F.col("component").isNotNull() & F.col("text_id").isNotNull())
    else:
        found = components_in_text(texts, learned).join(texts.select("text_id", "text"), "text_id")
    # a filter on the count would run it twice: rows without a mention have no place instead
    counted = found.withColumn("mentions", F.nullif(C.mentions(F.col("text"), F.col("component")), F.lit(0)))
    return (
        counted.groupBy("text_id")
        .agg(F.max_by(F.struct("component", "mentions"), F.when(F.col("mentions").isNotNull(), F.struct("mentions", -F.col("seen_at")))).alias("_m"))
        .where("_m IS NOT NULL")
        .select("text_id", "_m.component", F.col("_m.mentions").cast("bigint").alias("mentions"))
    )


def report_findings(reports: DataFrame, hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """What `cascades` reads, out of stored reports; reports that name no failing component are left out.

    `reports`: report_id, incident_id, tenant_id, ai_payload (JSON), created_at.  `hypotheses`:
    incident_id, component.  `evidence`: incident_id, text (one row per incident).
    """
    named = hypotheses.where("component IS NOT NULL").groupBy("incident_id").agg(
        F.collect_set("component").alias("hypothesis_components")
    )
    payload = F.from_json("ai_payload", REPORT_PAYLOAD)
    rows = reports.withColumn("_p", payload).where("_p.incidentFingerprint.primaryFailingComponent <> ''")
    steps = F.transform("_p.diagnosticReasoning", lambda s: F.concat_ws(" ", s["observation"], s["deduction"]))
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce(steps, none), F.coalesce(F.col("_p.rootCauseAnalysis.evidenceCitations"), none))
    return (
        rows.join(named, "incident_id", "left")
        .join(evidence.select("incident_id", F.col("text").alias("evidence_text")), "incident_id", "left")
        .select(
            "report_id", "tenant_id", F.col("_p.incidentFingerprint.primaryFailingComponent").alias("primary_component"),
            F.coalesce("hypothesis_components", none).alias("hypothesis_components"),
            F.filter(said, lambda t: t.isNotNull()).alias("reasoning"), "evidence_text", "created_at",
        )
    )


def cascades(findings: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """report_id, tenant_id, primary, downstream (array), created_at for reports that name a component.

    `findings`: report_id, tenant_id, primary_component, hypothesis_components (array),
    reasoning (array of texts), evidence_text, created_at.  Without learned names this is
    row-local work.
    """
    rows = findings.withColumn("primary", C.normalize_component(F.col("primary_component"))).where(
        C.is_plausible(F.col("primary"))
    )
    spoken = F.flatten(F.transform("reasoning", C.named_in_text))
    named = F.concat(F.coalesce("hypothesis_components", F.array().cast("array<string>")), F.coalesce(spoken, F.array().cast("array<string>")))
    if learned is not None:
        joined = rows.select(
            F.col("report_id").alias("text_id"), "tenant_id", F.concat_ws("\n", "reasoning").alias("text")
        ).withColumn("_low", F.lower("text"))
        known = learned.select("tenant_id", C.normalize_component(F.col("name")).alias("name"))
        heard = names_in_texts(joined, known, ["text_id"], "_low").groupBy("text_id").agg(F.collect_set("name").alias("_heard"))
        rows = rows.join(heard.withColumnRenamed("text_id", "report_id"), "report_id", "left")
        named = F.concat(named, F.coalesce("_heard", F.array().cast("array<string>")))
    once = F.array_distinct(F.transform(named, C.normalize_component))
    pairs = F.transform(once, lambda n: F.struct(n.alias("name"), C.normalize_component(n).alias("again")))
    silent = F.col("evidence_text").isNull() | (F.col("evidence_text") == "")

    def counts(e: Column, primary: Column, haystack: Column) -> Column:
        grounded = silent | ((e["again"] != "") & F.contains(haystack, e["again"]))
        return (e["name"] != "") & (e["name"] != primary) & C.plausible_name(e["again"]) & grounded

    # bound in one value: a column that only a lambda reads would be worked out again for every name
    about = F.struct(F.col("primary").alias("primary"), C.evidence_key(F.col("evidence_text")).alias("haystack"), pairs.alias("named"))
    downstream = C.bound(about, lambda x: F.transform(F.filter(x["named"], lambda e: counts(e, x["primary"], x["haystack"])), lambda e: e["name"]))
    return rows.select("report_id", "tenant_id", "primary", downstream.alias("downstream"), "created_at")


def build_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the cascades: counts by map-side partial aggregates.

    Equal cascades are counted first, once, for both; the names in texts are not looked for again.
    """
    alike = settle(
        found.groupBy("tenant_id", "primary", "downstream").agg(
            F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last")
        )
    )
    mentioned = alike.select("tenant_id", F.explode(F.concat(F.array("primary"), "downstream")).alias("component"), "n", "first")
    nodes = mentioned.groupBy("tenant_id", "component").agg(
        F.sum("n").alias("incident_count"), F.min("first").alias("first_seen_at")
    )
    edges = (
        alike.select("tenant_id", F.col("primary").alias("from_node"), F.explode("downstream").alias("to_node"), "n", "last")
        .groupBy("tenant_id", "from_node", "to_node")
        .agg(F.sum("n").alias("occurrence_count"), F.max("last").alias("last_seen_at"))
        .withColumn("failure_type", F.lit("cascade"))
    )
    return nodes, edges


def merge_graph(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add a batch's counts to the stored ones (nodes or edges)."""
    both = old.unionByName(new, allowMissingColumns=True)
    sums = {c: F.sum for c in ("incident_count", "occurrence_count")}
    aggs = []
    for c in both.columns:
        if c in keys:
            continue
        pick = sums.get(c) or (F.min if c.startswith("first") else F.max)
        aggs.append(pick(c).alias(c))
    return both.groupBy(*keys).agg(*aggs)


def graph_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Known downstream failures of every component that has any, most frequent first."""
    source = nodes.select("tenant_id", F.col("component").alias("from_node"), F.col("incident_count").alias("total_incidents"))
    target = nodes.select("tenant_id", F.col("component").alias("to_node"), F.col("component").alias("_name"))
    rows = edges.join(source, ["tenant_id", "from_node"]).join(target, ["tenant_id", "to_node"], "left")
    return rows.select(
        "tenant_id",
        F.col("from_node").alias("component"),
        "total_incidents",
        F.coalesce(F.col("_name").cast("string"), F.lit("unknown")).alias("downstream"),
        "occurrence_count",
        "last_seen_at",
    ).orderBy("tenant_id", "component", F.col("occurrence_count").desc(), "downstream")


def best_graph_context(texts: DataFrame, context: DataFrame) -> DataFrame:
    """text_id, component: of the components a text names, the one with most known downstream failures."""
    sizes = context.groupBy("tenant_id", "component").agg(
        F.count("*").alias("edge_count"), F.max("total_incidents").alias("total_incidents")
    )
    hits = components_in_text(texts).join(sizes, ["tenant_id", "component"])
    return (
        hits.groupBy("text_id", "tenant_id")
        .agg(F.max_by(F.struct("component", "edge_count", "total_incidents"), F.struct("edge_count", -F.col("seen_at"))).alias("_b"))
        .select("text_id", "tenant_id", "_b.*")
    )


def blast_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Cascade of every root at once: component, wave, occurrences, probability.

    `roots`: tenant_id, root.  Level by level; a node keeps the first path that reached it.
    Paths are compared by the edges they took, so no per-root ordering window is needed; the
    first path is found by an aggregate.  A path is the places its edges have among those of
    their node, four bytes each: paths of a root part at one node, so places compare as the
    nodes they lead to.  Each level is a table, which keeps the plan flat, lets a lost executor
    re-read a level instead of recomputing the walk, and leaves only tables on disk behind it.
    """
    known = nodes.select("tenant_id", F.col("component").alias("node"))
    targets = known.select("tenant_id", F.col("node").alias("next")).distinct()
    # targets that are no nodes are neither shown nor walked on: their edges go before the walk.
    # Of several edges between two nodes the least count is the one that paths compare first
    steps = (
        edges.select("tenant_id", F.col("from_node").alias("node"), F.col("to_node").alias("next"), "occurrence_count")
        .join(targets, ["tenant_id", "next"], "left_semi")
        .groupBy("tenant_id", "next", "node").agg(F.min(F.struct("occurrence_count")).alias("_e"))
        .select("tenant_id", "node", "next", "_e.occurrence_count")
    )
    placed = OrderedSlices(steps, ["tenant_id", "node"], [F.col("next")]).rank("place").frame()
    steps = stored(placed.withColumn("place", F.unhex(F.lpad(F.hex("place"), 8, "0"))))
    start = roots.select("tenant_id", "root", F.col("root").alias("node")).join(known, ["tenant_id", "node"], "left_semi")
    frontier = stored(start.distinct()).withColumns({"strength": F.lit(1.0), "path": F.lit(b"")})
    keys = ["tenant_id", "root", "node"]
    none = frontier.limit(0).select(*keys, F.lit(0).cast("bigint").alias("occurrence_count"), "strength", F.lit(0).alias("wave"))
    levels: list[DataFrame] = []
    for wave in range(1, max_depth + 1):
        reached = frontier.join(steps, ["tenant_id", "node"]).where("next <> root").select(
            "tenant_id", "root", F.col("next").alias("node"), F.concat("path", "place").alias("path"), "occurrence_count",
            (F.col("strength") * F.least(F.col("occurrence_count") / 10, F.lit(1.0)) * F.lit(DECAY)).alias("strength"),
        )
        if levels:  # the first level has each target once
            visited = reduce(DataFrame.unionByName, [level.select(*keys) for level in levels])
            first = F.min(F.struct("path", "occurrence_count", "strength")).alias("_f")
            reached = reached.join(visited, keys, "left_anti").groupBy(*keys).agg(first).select(*keys, "_f.*")
        reached = stored(reached if wave < max_depth else reached.drop("path"))
        if reached.isEmpty():
            break
        levels.append(reached)
        frontier = reached.drop("occurrence_count")
    shown = reduce(
        DataFrame.unionByName,
        [level.select(*keys, "occurrence_count", "strength", F.lit(wave).alias("wave")) for wave, level in enumerate(levels, 1)] or [none],
    )
    return shown.orderBy("tenant_id", "root", "wave", F.col("strength").desc(), "node").select(
        "tenant_id", "root", F.col("node").alias("component"), "wave",
        F.when(F.col("wave") == 1, F.col("root")).alias("via_component"),
        "occurrence_count",
        F.floor(F.col("strength") * 100 + 0.5).cast("bigint").alias("estimated_probability"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per tenant."""
    n = nodes.groupBy("tenant_id").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("tenant_id").agg(F.count("*").alias("edge_count"))
    return n.join(e, "tenant_id", "full").select(
        "tenant_id",
        F.coalesce("node_count", F.lit(0).cast("bigint")).alias("node_count"),
        F.coalesce("edge_count", F.lit(0).cast("bigint")).alias("edge_count"),
    )


def busiest_components(edges: DataFrame, k: int) -> DataFrame:
    """The k components per tenant that most often took others down (a top-k report)."""
    totals = edges.groupBy("tenant_id", "from_node").agg(F.sum("occurrence_count").alias("total"))
    best = top_per_key(totals, ["tenant_id"], [F.col("total").desc(), F.col("from_node").asc()], k)
    return best.select("tenant_id", F.col("from_node").alias("root"), "total")


def connectivity(members: DataFrame, links: DataFrame) -> DataFrame:
    """incident_id, connected: whether the voters of an incident form one component.

    `members`: incident_id, voter.  `links`: incident_id, voter_a, voter_b, weight.  Every voter
    takes the least label among itself, its neighbours and its label's label until nothing
    moves, so labels travel exponentially far per round.
    """
    both = links.where("weight > 0").select("incident_id", "voter_a", "voter_b")
    both = both.unionByName(both.select("incident_id", F.col("voter_b").alias("voter_a"), F.col("voter_a").alias("voter_b")))
    both = settle(both.distinct())
    state = settle(members.select("incident_id", "voter", F.col("voter").alias("label")).distinct())
    while True:
        of = state.select("incident_id", F.col("voter").alias("voter_b"), F.col("label").alias("near"))
        near = both.join(of, ["incident_id", "voter_b"]).groupBy("incident_id", F.col("voter_a").alias("voter")).agg(
            F.min("near").alias("near")
        )
        jump = state.select("incident_id", F.col("voter").alias("label"), F.col("label").alias("far"))
        moved = (
            state.join(near, ["incident_id", "voter"], "left")
            .join(jump, ["incident_id", "label"], "left")
            .select("incident_id", "voter", F.least("label", "near", "far").alias("new"), "label")
        )
        moved = settle(moved)
        state = moved.select("incident_id", "voter", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            break
    return state.groupBy("incident_id").agg((F.count_distinct("label") == 1).alias("connected"))
