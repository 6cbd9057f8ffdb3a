import datetime as dt
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweir.functions import components as C
from signalweir.operators import graph, matching
from signalweir.session import settle, shared_folder


@pytest.mark.parametrize(
    "raw, name",
    [("Payment-Service", "payment-service"), ("payment_service", "payment-service"), ("  payment service  ", "payment-service"),
     ("auth-service-7d9f", "auth-service"), ("auth-service-12", "auth-service"), (None, ""), ("", "")],
)
def test_one_spelling(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "c string").select(C.normalize_component(F.col("c"))).first()[0] == name


def test_names_and_descriptions(spark):
    bad = ["database connection pool", "upstream service", "the database", "worker pool", "thread-pool", "cpu load", "request rate", "ab", "", None]
    good = ["payment-service", "api-gateway", "postgres", "redis", "notifier", "token-cache", "db-pooler", "message-queue"]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(bad + good)], "n int, c string")
    got = [r[1] for r in df.select("n", C.is_plausible(F.col("c"))).orderBy("n").collect()]
    assert got == [False] * len(bad) + [True] * len(good)


def test_grounding(spark):
    log = "ERROR checkout-service 500 upstream timeout\nERROR payment service connection pool exhausted"
    cases = [("payment_service", log, True), ("checkout-service", log, True), ("worker-pool", log, False), ("anything", "", True), ("anything", None, True)]
    df = spark.createDataFrame([(n, *c[:2]) for n, c in enumerate(cases)], "n int, c string, e string")
    got = [r[1] for r in df.select("n", C.is_grounded(F.col("c"), F.col("e"))).orderBy("n").collect()]
    assert got == [c[2] for c in cases]


def _found(spark, text, learned=()):
    texts = spark.createDataFrame([(1, "t", text)], "text_id long, tenant_id string, text string")
    known = spark.createDataFrame([("t", n) for n in learned], "tenant_id string, name string") if learned else None
    return {r.component for r in graph.components_in_text(texts, known).collect()}


def test_names_in_text(spark):
    for name in ["checkout-service", "widget-api", "session-cache", "events-queue", "conn-pooler"]:
        assert name in _found(spark, f"errors observed in {name} during the window")
    assert _found(spark, "postgres and redis both degraded") == {"postgres", "redis"}
    for text in ["content-type header was wrong", "the error-rate climbed", "connection-pool size", "read-only mode", ""]:
        assert _found(spark, text) == set()
    assert _found(spark, "Payment_Service threw") == {"payment-service"}
    assert _found(spark, "latency traced to Widget-store", ["widget-store"]) == {"widget-store"}
    learned = ["payment-service (connection pool)", "a+b*c"]  # names are text, not patterns
    assert _found(spark, "payment-service (connection pool) failed", learned) == {"payment-service"}


def test_primary(spark):
    rows = [(1, "t", "postgres slow. postgres restarted. redis fine."), (2, "t", "nothing here"), (3, "t", "redis then kafka")]
    texts = spark.createDataFrame(rows, "text_id long, tenant_id string, text string")
    assert {r.text_id: r.component for r in graph.primary_component(texts).collect()} == {1: "postgres", 3: "redis"}


def test_names_meet_texts_of_their_tenant(spark):
    texts = spark.createDataFrame([(i, "t" if i % 2 else "u", f"n{i} and n{i * 7 % 50} x") for i in range(80)] * 2 + [(900, "t", None), (901, "t", "")], "id long, tenant_id string, text string")
    names = spark.createDataFrame([("t", f"n{i}") for i in range(50)] + [("u", "n1"), ("t", ""), ("t", None), ("t", "and n"), ("t", "longer than any")], "tenant_id string, name string")
    once = sorted(map(tuple, matching.names_in_texts(texts, names, ["id"]).collect()))
    want = sorted({(r.id, n) for r in texts.where("text <> ''").collect() for n in {f"n{i}" for i in range(50)} | {"and n"} if n in r.text and (r.tenant_id == "t" or n == "n1")})
    assert once == want


FINDINGS = "report_id long, tenant_id string, primary_component string, hypothesis_components array<string>, reasoning array<string>, evidence_text string, created_at timestamp"


def _graph(spark, rows, learned=None):
    at = dt.datetime(2024, 1, 1)
    full = [(n, *r, at + dt.timedelta(days=n)) for n, r in enumerate(rows)]
    return graph.build_graph(graph.cascades(spark.createDataFrame(full, FINDINGS), learned))


def _counts(df):
    return {(r.tenant_id, r.component): r.incident_count for r in df.collect()}


def test_repeats_count_up_and_spellings_meet(spark):
    nodes, edges = _graph(spark, [("t", "Auth-Service", [], [], ""), ("t", "auth_service", [], [], ""), ("t", "auth-service-7d9f", [], [], ""), ("u", "auth-service", [], [], "")])
    assert _counts(nodes) == {("t", "auth-service"): 3, ("u", "auth-service"): 1} and edges.count() == 0


def test_only_grounded_names_become_nodes(spark):
    evidence = "checkout-service 500 upstream timeout\npayment-service connection pool exhausted"
    named = ["payment-service", "checkout-service", "database connection pool", "the upstream service", "elasticsearch", "api-gateway"]
    nodes, edges = _graph(spark, [("t", "api-gateway", named, [], evidence), ("t", "the upstream service", ["redis"], [], ""), ("t", None, ["redis"], [], "")])
    assert set(_counts(nodes)) == {("t", "api-gateway"), ("t", "checkout-service"), ("t", "payment-service")} and edges.count() == 2


def test_learned_names_and_merge(spark):
    first = _graph(spark, [("t", "auth-service", ["widget-store"], [], "")])
    known = first[0].select("tenant_id", F.col("component").alias("name"))
    second = _graph(spark, [("t", "auth-service", [], ["latency traced to widget-store"], "")], known)
    nodes = graph.merge_graph(first[0], second[0], ["tenant_id", "component"])
    edges = graph.merge_graph(first[1], second[1], ["tenant_id", "from_node", "to_node"])
    assert _counts(nodes) == {("t", "auth-service"): 2, ("t", "widget-store"): 2}
    assert [r.occurrence_count for r in edges.collect()] == [2]


@pytest.fixture(scope="module")
def seeded(spark):
    at = dt.datetime(2024, 1, 1)
    edges = [("db-pooler", "auth-service", 22), ("db-pooler", "api-gateway", 22), ("db-pooler", "k8s-monitor", 20), ("auth-service", "redis", 1), ("redis", "db-pooler", 9)]
    names = ["db-pooler", "auth-service", "api-gateway", "k8s-monitor", "redis"]
    return (
        spark.createDataFrame([("t", n, 5) for n in names], "tenant_id string, component string, incident_count long"),
        spark.createDataFrame([("t", *e, at) for e in edges], "tenant_id string, from_node string, to_node string, occurrence_count long, last_seen_at timestamp"),
    )


def test_blast_radius(spark, seeded):
    roots = spark.createDataFrame([("t", "db-pooler"), ("t", "nobody")], "tenant_id string, root string")
    got = {r.component: r for r in graph.blast_radius(*seeded, roots).collect()}
    assert set(got) == {"auth-service", "api-gateway", "k8s-monitor", "redis"}  # visited once, no way back to the root
    assert {c: got[c].estimated_probability for c in got} == {"auth-service": 85, "api-gateway": 85, "k8s-monitor": 85, "redis": 7}
    assert got["redis"].wave == 2 and got["redis"].via_component is None and got["auth-service"].via_component == "db-pooler"
    assert graph.blast_radius(*seeded, roots, max_depth=1).count() == 3
    assert graph.blast_radius(*seeded, roots.where("root = 'nobody'")).count() == 0


def test_context(spark, seeded):
    nodes, edges = seeded
    ctx = graph.graph_context(nodes.where("component <> 'redis'"), edges)
    rows = {(r.component, r.downstream): r.occurrence_count for r in ctx.collect()}
    assert rows[("auth-service", "unknown")] == 1 and rows[("db-pooler", "k8s-monitor")] == 20
    texts = spark.createDataFrame([(1, "t", "auth-service and db-pooler down"), (2, "u", "db-pooler")], "text_id long, tenant_id string, text string")
    assert [(r.text_id, r.component, r.edge_count) for r in graph.best_graph_context(texts, ctx).collect()] == [(1, "db-pooler", 3)]


def test_connectivity(spark):
    members = spark.createDataFrame([(i, f"v{n}") for i in (1, 2, 3) for n in range(9)] + [(4, "v0")], "incident_id long, voter string")
    path = [(1, f"v{n}", f"v{n + 1}", 1.0) for n in range(8)]
    broken = [(2, f"v{n}", f"v{n + 1}", 1.0) for n in range(8) if n != 4] + [(3, "v0", "v1", 0.0)]
    links = spark.createDataFrame(path + broken, "incident_id long, voter_a string, voter_b string, weight double")
    assert {r.incident_id: r.connected for r in graph.connectivity(members, links).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_names_are_looked_for_once(spark):
    """Neither filters nor lambdas run the patterns again; equal cascades are counted together."""
    rows = [(i, "t", "Auth_Service", ["db pooler", "the upstream"], ["orders-api slow"], "db-pooler \t orders_api", T) for i, T in enumerate(("2024-01-02", "2024-01-01"))]
    found = graph.cascades(spark.createDataFrame(rows, "report_id long, tenant_id string, primary_component string, hypothesis_components array<string>, reasoning array<string>, evidence_text string, created_at string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("regexp_extract_all") for line in plan.splitlines()) == 2
    assert max(line.count("regexp_replace") for line in plan.splitlines()) < 20
    nodes, edges = graph.build_graph(found)
    assert "regexp" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in edges.collect()} == {("t", "auth-service", n, 2, "2024-01-02", "cascade") for n in ("db-pooler", "orders-api")}
    assert {tuple(r) for r in nodes.collect()} == {("t", n, 2, "2024-01-01") for n in ("auth-service", "db-pooler", "orders-api")}


def test_blast_radius_asks_the_nodes_before_the_walk(spark):
    """Targets that are no nodes are not shown and not walked on; the levels are not joined with the nodes again."""
    nodes = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "d"), ("u", "x"), (None, "a")], "tenant_id string, component string")
    edges = spark.createDataFrame(
        [("t", "a", "b", 10), ("t", "a", "x", 10), ("t", "x", "d", 10), ("t", "b", "d", 5), ("t", "b", None, 5), ("t", "d", "a", 9)],
        "tenant_id string, from_node string, to_node string, occurrence_count long",
    )
    roots = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "x"), ("u", "x")], "tenant_id string, root string")
    shown = graph.blast_radius(nodes, edges, roots)
    assert [(r.root, r.component, r.wave, r.via_component, r.estimated_probability) for r in shown.collect()] == [("a", "b", 1, "a", 85), ("a", "d", 2, None, 36)]
    assert "Join" not in shown._jdf.queryExecution().toString()


def test_blast_radius_equals_a_walk_in_python(spark):
    """Shared targets, ways back, several edges between two nodes, targets that are no nodes, one hub; roots come twice."""
    rng = np.random.default_rng(8)
    names = [f"n{i}" for i in range(40)]
    pairs = [(names[a], names[b]) for a, b in rng.integers(0, 40, (70, 2))] + [("n0", n) for n in names[1:30]] + [("n3", "gone"), ("n3", None), (None, "n3")]
    edges = [(t, *p, int(c)) for t in "tu" for p, c in zip(pairs, rng.integers(1, 14, len(pairs)))] + [("t", *p, 3) for p in pairs[:20]] + [("t", *p, None) for p in pairs[:5]] + [(None, "n1", "n2", 4)]
    least = {}
    for t, a, b, c in edges:
        if t and b in names:
            least[t, a, b] = min(least.get((t, a, b), c), c, key=lambda x: (x is not None, x or 0))
    want = set()
    for t in "tu":
        for root in names:
            seen, frontier = {root}, {root: ((), 1.0)}
            for wave in range(1, 5):
                reached = {}
                for a, (path, strength) in frontier.items():
                    for (tenant, x, b), c in least.items():
                        if tenant == t and x == a and b not in seen:
                            found = ((*path, b), strength * (1.0 if c is None else min(c / 10, 1.0)) * 0.85, c)
                            reached[b] = min(reached.get(b, found), found, key=lambda f: f[0])
                want |= {(t, root, b, wave, root if wave == 1 else None, c, math.floor(s * 100 + 0.5)) for b, (_, s, c) in reached.items()}
                seen |= set(reached)
                frontier = {b: f[:2] for b, f in reached.items()}
    got = [
        tuple(r)
        for r in graph.blast_radius(
            spark.createDataFrame([(t, n) for t in "tu" for n in names] * 2, "tenant_id string, component string"),
            spark.createDataFrame(edges, "tenant_id string, from_node string, to_node string, occurrence_count long"),
            spark.createDataFrame([(t, n) for t in ("t", "u", None) for n in [*names, "gone", None]] * 2, "tenant_id string, root string"),
        ).collect()
    ]
    assert len(got) == len(set(got)) and set(got) == want
    assert [r[:2] + r[3:4] for r in got] == sorted(r[:2] + r[3:4] for r in got)


def test_blast_radius_leaves_little_on_disk(spark):
    """Levels are compressed tables, and what they shuffled goes with each: the walk's disk does not add up."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = Path(shared_folder(spark).removeprefix("file:"))

    def held():
        files = [Path(f) for f in blocks.getAllFiles().mkString("\n").split("\n")]
        shuffled = sum(f.stat().st_size for f in files if f.name.startswith("shuffle") and f.exists())
        return shuffled + sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    edges = settle(spark.range(12_000).selectExpr("'t' AS tenant_id", "id DIV 2 AS from_node", "(id DIV 2 * 7 + id % 2) % 6000 AS to_node", "1 + id % 9 AS occurrence_count"))
    nodes = edges.selectExpr("tenant_id", "from_node AS component").distinct()
    before = held()
    rows = graph.blast_radius(nodes, edges, nodes.withColumnRenamed("component", "root"))
    left = held() - before
    assert left < 16 * rows.count(), left / rows.count()
