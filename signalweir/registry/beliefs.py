"""Queries over beliefs, votes and runbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweir.operators import beliefs, graph, runbooks
from signalweir.registry.base import query, rounded
from signalweir.registry.views import view, with_views

_NORMAL = """k AS (SELECT *, trim(regexp_replace(lower(trim(hypothesis)), '[^a-z0-9]+', ' ', 'g')) AS hkey FROM v_raw_hypotheses),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, hkey ORDER BY position) AS dup FROM k) WHERE dup = 1),
m AS (SELECT incident_id, count(*) AS n, count(prior) AS w, sum(prior) AS total FROM d GROUP BY 1),
s AS (SELECT d.*, CASE WHEN n <> w THEN 1.0::DOUBLE / n ELSE d.prior / total END AS p FROM d JOIN m ON m.incident_id = d.incident_id),
r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY p DESC, position) AS rank FROM s),
h AS (SELECT incident_id, tenant_id, concat('H', CAST(rank AS VARCHAR)) AS hypothesis_id, hypothesis, component, rank, position,
  p / sum(p) OVER (PARTITION BY incident_id) AS prior FROM r WHERE rank <= 6 AND p >= 0.01)"""
_ALIGNED = """ids AS (SELECT DISTINCT incident_id, hypothesis_id FROM v_ballots),
sized AS (SELECT *, count(*) OVER (PARTITION BY incident_id) AS m FROM ids),
grid AS (SELECT v.incident_id, v.voter, i.hypothesis_id, i.m FROM (SELECT DISTINCT incident_id, voter FROM v_ballots) v JOIN sized i ON i.incident_id = v.incident_id),
filled AS (SELECT g.*, coalesce(b.prior, 0) AS prior FROM grid g LEFT JOIN v_ballots b USING (incident_id, voter, hypothesis_id)),
al AS (SELECT incident_id, voter, hypothesis_id, CASE WHEN sum(prior) OVER w > 0 THEN prior / sum(prior) OVER w ELSE 1.0::DOUBLE / m END AS p FROM filled WINDOW w AS (PARTITION BY incident_id, voter)),
pool AS (SELECT incident_id, hypothesis_id, avg(p) AS bar FROM al GROUP BY 1, 2),
kl AS (SELECT a.incident_id, a.voter, sum(CASE WHEN p <= 0 THEN 0 ELSE p * ln(p / bar) END) AS kl FROM al a JOIN pool USING (incident_id, hypothesis_id) GROUP BY 1, 2)"""


def _hypotheses(spark, sf_dir):
    raw = view(spark, sf_dir, "v_raw_hypotheses")
    about = raw.select("incident_id", "position", "tenant_id", "component")
    return beliefs.normalize_hypotheses(raw).join(about, ["incident_id", "position"])


def _aligned(spark, sf_dir):
    ballots = view(spark, sf_dir, "v_ballots")
    return beliefs.align_votes(ballots, ballots)


@query(
    "b1_normalized_hypotheses",
    with_views(["v_raw_hypotheses"], _NORMAL + " SELECT incident_id, hypothesis_id, hypothesis, round(prior, 6) AS prior FROM h"),
)
def normalized(spark, sf_dir):
    out = beliefs.normalize_hypotheses(view(spark, sf_dir, "v_raw_hypotheses"))
    return rounded(out.select("incident_id", "hypothesis_id", "hypothesis", "prior"), "prior")


def _answers(spark, sf_dir):
    """The raw items as model answers: JSON arrays of objects, of plain strings where no prior is given."""
    quoted = F.to_json(F.array("hypothesis"))
    item = F.when(F.col("prior").isNull(), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(
        F.to_json(F.struct(F.concat(F.lit("  "), "hypothesis").alias("rootCause"), F.col("prior").alias("probability"), "component",
                           F.array(F.lit("one"), F.lit("two"), F.lit("three"), F.lit("four")).alias("evidence")))
    )
    rows = view(spark, sf_dir, "v_raw_hypotheses").withColumn("item", item)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda e: e["item"])
    return rows.groupBy("incident_id").agg(F.concat(F.lit('[{"prior":1},"  ",7,'), F.array_join(listed, ","), F.lit("]")).alias("answer"))


@query(
    "b1_raw_answers",
    with_views(["v_raw_hypotheses"], _NORMAL + " SELECT incident_id, hypothesis_id, hypothesis, round(prior, 6) AS prior FROM h"),
)
def raw_answers(spark, sf_dir):
    out = beliefs.normalize_hypotheses(beliefs.parse_answers(_answers(spark, sf_dir)))
    return rounded(out.select("incident_id", "hypothesis_id", "hypothesis", "prior"), "prior")


@query(
    "b2_attached_details",
    with_views(
        ["v_raw_hypotheses"],
        _NORMAL
        + """, last AS (SELECT incident_id, trim(hypothesis) AS hypothesis, arg_max(struct_pack(c := CASE WHEN prior IS NOT NULL THEN component END,
  e := CASE WHEN prior IS NOT NULL THEN 'one,two,three' END), position) AS d FROM v_raw_hypotheses GROUP BY 1, 2)
SELECT h.incident_id, h.hypothesis_id, d.c AS component, d.e AS evidence FROM h JOIN last USING (incident_id, hypothesis)""",
    ),
)
def attached_details(spark, sf_dir):
    raw = beliefs.parse_answers(_answers(spark, sf_dir))
    out = beliefs.attach_details(beliefs.normalize_hypotheses(raw), raw)
    evidence = F.when(F.col("evidence").isNotNull(), F.array_join("evidence", ","))
    return out.select("incident_id", "hypothesis_id", "component", evidence.alias("evidence"))


_SUMMARY = """e AS (SELECT incident_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, count(*) AS hypotheses FROM bel GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(p, 12) DESC, hypothesis_id) AS rk FROM bel),
l AS (SELECT incident_id, max(hypothesis_id) FILTER (WHERE rk = 1) AS leading_id, max(p) FILTER (WHERE rk = 1) AS leading_prior, coalesce(max(p) FILTER (WHERE rk = 2), 0) AS second FROM o GROUP BY 1),
summ AS (SELECT e.incident_id, entropy, hypotheses, CASE WHEN hypotheses > 1 THEN entropy / ln(hypotheses) ELSE 0 END AS uncertainty,
  leading_id, leading_prior, leading_prior >= 0.4 AND leading_prior - second >= 0.15 AS decisive FROM e JOIN l USING (incident_id))"""
_SUMMARY_OUT = """round(entropy, 6) AS entropy, hypotheses, round(uncertainty, 6) AS uncertainty, leading_id, round(leading_prior, 6) AS leading_prior, decisive"""


@query(
    "b2_belief_summary",
    with_views(
        ["v_raw_hypotheses"],
        _NORMAL + ", bel AS (SELECT incident_id, hypothesis_id, prior AS p FROM h), " + _SUMMARY + f" SELECT incident_id, {_SUMMARY_OUT} FROM summ",
    ),
)
def summary(spark, sf_dir):
    out = beliefs.belief_summary(beliefs.normalize_hypotheses(view(spark, sf_dir, "v_raw_hypotheses")))
    return rounded(out, "entropy", "uncertainty", "leading_prior")


_HISTORY = """nodes AS (SELECT tenant_id, lower(entity) AS name, count(*) AS n FROM v_signals GROUP BY 1, 2)"""


@query(
    "b3_graph_vote",
    with_views(
        ["v_raw_hypotheses", "v_signals"],
        _NORMAL
        + ", "
        + _HISTORY
        + """, sc AS (SELECT h.incident_id, h.hypothesis_id, h.rank, h.component, 1 + coalesce((SELECT max(n) FROM nodes x WHERE x.tenant_id = h.tenant_id
    AND h.component IS NOT NULL AND (contains(x.name, lower(h.component)) OR contains(lower(h.component), x.name))), 0) AS score FROM h),
ok AS (SELECT incident_id FROM sc GROUP BY 1 HAVING min(score) < max(score) AND count(component) > 0),
q AS (SELECT sc.*, score / sum(score) OVER (PARTITION BY incident_id) AS p FROM sc JOIN ok USING (incident_id)),
q2 AS (SELECT * FROM q WHERE p >= 0.01)
SELECT incident_id, 'graph' AS voter, hypothesis_id, round(p / sum(p) OVER (PARTITION BY incident_id), 6) AS prior FROM q2""",
    ),
)
def graph_vote(spark, sf_dir):
    nodes = (
        view(spark, sf_dir, "v_signals")
        .groupBy("tenant_id", F.col("entity").alias("component"))
        .agg(F.count("*").alias("incident_count"))
    )
    return rounded(beliefs.graph_vote(_hypotheses(spark, sf_dir), nodes), "prior")


@query(
    "b4_clean_votes",
    with_views(
        ["v_ballots"],
        """v AS (SELECT * FROM v_ballots WHERE prior > 0 AND hypothesis_id <> 'N'),
n AS (SELECT *, count(*) OVER w AS n, sum(prior) OVER w AS t FROM v WINDOW w AS (PARTITION BY incident_id, voter))
SELECT incident_id, voter, hypothesis_id, round(prior / t, 6) AS prior FROM n WHERE n >= 2""",
    ),
)
def clean_votes(spark, sf_dir):
    ballots = view(spark, sf_dir, "v_ballots")
    known = ballots.where("hypothesis_id <> 'N'")
    return rounded(beliefs.clean_votes(ballots, known), "prior")


@query(
    "b5_aligned_votes",
    with_views(["v_ballots"], _ALIGNED + " SELECT incident_id, voter, hypothesis_id, round(p, 6) AS prior FROM al"),
)
def aligned(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir), "prior")


@query(
    "a10_linear_pool",
    with_views(["v_ballots"], _ALIGNED + " SELECT incident_id, hypothesis_id, round(bar, 6) AS prior FROM pool"),
)
def linear_pool(spark, sf_dir):
    return rounded(beliefs.linear_pool(_aligned(spark, sf_dir)), "prior")


@query(
    "a11_voter_divergence",
    with_views(["v_ballots"], _ALIGNED + " SELECT incident_id, voter, round(kl, 6) AS initial_kl FROM kl"),
)
def voter_divergence(spark, sf_dir):
    return rounded(beliefs.voter_divergence(_aligned(spark, sf_dir)), "initial_kl")


@query(
    "b8_disagreement",
    with_views(
        ["v_ballots"],
        _ALIGNED
        + ", bel AS (SELECT incident_id, hypothesis_id, bar AS p FROM pool), "
        + _SUMMARY
        + f""", x AS (SELECT incident_id, count(*) AS voters, max(kl) AS d FROM kl GROUP BY 1)
SELECT s.incident_id, {_SUMMARY_OUT}, voters, round(CASE WHEN voters = 1 THEN 0 ELSE d END, 6) AS initial_disagreement,
  CASE WHEN voters > 1 AND d >= 0.001 THEN 1 ELSE 0 END AS iterations, round(CASE WHEN voters = 1 OR d >= 0.001 THEN 0 ELSE d END, 6) AS final_disagreement,
  voters = 1 AS single_agent, true AS converged, round(CASE WHEN voters = 1 THEN 0 ELSE 1.0 / voters END, 6) AS alpha,
  CASE WHEN voters = 1 THEN 0 ELSE CAST(voters AS DOUBLE) END AS fiedler, voters > 1 AND d < 0.01 AS suspicious
FROM summ s JOIN x ON x.incident_id = s.incident_id""",
    ),
)
def disagreement(spark, sf_dir):
    out = beliefs.disagreement(_aligned(spark, sf_dir))
    return rounded(
        out, "entropy", "uncertainty", "leading_prior", "initial_disagreement", "final_disagreement", "alpha"
    )


def _path_links(voters):
    """Each voter linked to the next one in name order: a path per incident."""
    from pyspark.sql import Window

    nxt = F.lead("voter").over(Window.partitionBy("incident_id").orderBy("voter"))
    one_way = voters.select("incident_id", F.col("voter").alias("voter_a"), nxt.alias("voter_b")).where("voter_b IS NOT NULL")
    back = one_way.select("incident_id", F.col("voter_b").alias("voter_a"), F.col("voter_a").alias("voter_b"))
    return one_way.unionByName(back).withColumn("weight", F.lit(1.0))


@query(
    "b7_pool_on_path",
    with_views(
        ["v_ballots"],
        _ALIGNED
        + " SELECT p.incident_id, p.hypothesis_id, round(p.bar, 6) AS prior, round((SELECT max(kl) FROM kl WHERE kl.incident_id = p.incident_id), 6) AS initial_disagreement, true AS settled FROM pool p",
    ),
)
def pool_on_path(spark, sf_dir):
    votes = _aligned(spark, sf_dir)
    links = _path_links(votes.select("incident_id", "voter").distinct())
    pooled, _, report = beliefs.pool_beliefs_on_graph(votes, links)
    settled = (F.col("final_disagreement") < beliefs.EPSILON) & F.col("converged")
    out = pooled.join(report, "incident_id").select(
        "incident_id", "hypothesis_id", "prior", "initial_disagreement", settled.alias("settled")
    )
    return rounded(out, "prior", "initial_disagreement")


@query(
    "b7_fiedler",
    with_views(
        ["v_ballots"],
        """v AS (SELECT DISTINCT incident_id, voter FROM v_ballots), n AS (SELECT incident_id, count(*) AS voters FROM v GROUP BY 1)
SELECT incident_id, voters, CAST(CASE voters WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS star,
  CASE WHEN voters = 1 THEN 0.0::DOUBLE ELSE round(2 - 2 * cos(pi() / voters), 6) END AS path FROM n""",
    ),
)
def fiedler(spark, sf_dir):
    """The second eigenvalue where all voters hear the first one by name, and where each hears its neighbours."""
    voters = view(spark, sf_dir, "v_ballots").select("incident_id", "voter").distinct()
    first = voters.groupBy("incident_id").agg(F.min("voter").alias("voter_b"))
    out = voters.withColumnRenamed("voter", "voter_a").join(first, "incident_id").where("voter_a <> voter_b")
    back = out.select("incident_id", F.col("voter_b").alias("voter_a"), F.col("voter_a").alias("voter_b"))
    star = beliefs.algebraic_connectivity(voters, out.unionByName(back).withColumn("weight", F.lit(1.0)))
    path = beliefs.algebraic_connectivity(voters, _path_links(voters)).select("incident_id", F.col("fiedler").alias("path"))
    return rounded(star.withColumnRenamed("fiedler", "star").join(path, "incident_id"), "star", "path")


@query(
    "g6_voter_connectivity",
    with_views(
        ["v_ballots"],
        """v AS (SELECT DISTINCT incident_id, voter FROM v_ballots)
SELECT incident_id, CAST(substr(incident_id, 2) AS BIGINT) % 3 <> 0 OR count(*) = 1 OR count(DISTINCT substr(voter, 1, 1)) = 1 AS connected FROM v GROUP BY 1""",
    ),
)
def connectivity(spark, sf_dir):
    voters = view(spark, sf_dir, "v_ballots").select("incident_id", "voter").distinct()
    links = _path_links(voters)
    # every third incident loses the links between the two voter families
    cut = (F.substring("incident_id", 2, 20).cast("bigint") % 3 == 0) & (
        F.substring("voter_a", 1, 1) != F.substring("voter_b", 1, 1)
    )
    return graph.connectivity(voters, links.where(~cut))


# --- runbooks ---

_SCORED = """sc AS (SELECT *, 100.0 / (1 + recovery_minutes / 15) AS rec, (11.0 - blast_radius) / 10 * 100 AS safe,
  CASE reversibility WHEN 'easy' THEN 100 WHEN 'hard' THEN 50 ELSE 0 END AS undo, CASE evidence_quality WHEN 'high' THEN 100 WHEN 'medium' THEN 60 ELSE 25 END AS ev,
  CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 ELSE 0.7 END AS trust FROM v_steps),
scored AS (SELECT *, CAST(trust AS DOUBLE) * CASE WHEN step_type = 'diagnostic' THEN 0.45::DOUBLE * decision_value + 0.2::DOUBLE * safe + 0.15::DOUBLE * undo + 0.2::DOUBLE * ev
  ELSE 0.35::DOUBLE * success_probability + 0.15::DOUBLE * root_cause_probability + 0.15::DOUBLE * rec + 0.15::DOUBLE * safe + 0.1::DOUBLE * undo + 0.1::DOUBLE * ev END AS composite FROM sc),
gaps AS (SELECT *, lag(composite) OVER (PARTITION BY report_id ORDER BY round(composite, 9) DESC, step_id) - composite AS gap FROM scored),
clus AS (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY round(composite, 9) DESC, step_id) AS cluster FROM gaps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY cluster, blast_radius, CASE reversibility WHEN 'easy' THEN 0 WHEN 'hard' THEN 1 ELSE 2 END,
  CASE evidence_quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(composite, 9) DESC, step_id) AS rank FROM clus)"""


def _ranked(spark, sf_dir):
    return runbooks.rank_steps(runbooks.score_steps(view(spark, sf_dir, "v_steps")))


@query(
    "k1_step_scores",
    with_views(["v_steps"], _SCORED + " SELECT step_id, round(composite, 6) AS composite, CAST(floor(composite + 0.5) AS BIGINT) AS composite_score FROM scored"),
)
def step_scores(spark, sf_dir):
    out = runbooks.score_steps(view(spark, sf_dir, "v_steps"))
    return rounded(out.select("step_id", "composite", "composite_score"), "composite")


@query("w11_merit_rank", with_views(["v_steps"], _SCORED + " SELECT report_id, step_id, rank FROM ranked"))
def merit_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("report_id", "step_id", "rank")


@query(
    "k2_recommended_actions",
    with_views(
        ["v_steps"],
        _SCORED
        + """, el AS (SELECT r.*, NOT (blast_radius >= 8 AND reversibility = 'impossible') OR NOT EXISTS (SELECT 1 FROM ranked o
    WHERE o.report_id = r.report_id AND o.step_id <> r.step_id AND r.composite - o.composite < 20) AS eligible FROM ranked r)
SELECT report_id, coalesce(arg_min(step_id, rank) FILTER (WHERE eligible), arg_min(step_id, rank)) AS first_action,
  arg_min(step_id, -blast_radius * 1000000 + step_id) AS highest_risk_action, arg_min(step_id, rank) AS highest_confidence_action, count(*) AS steps FROM el GROUP BY 1""",
    ),
)
def recommended(spark, sf_dir):
    return runbooks.recommended_actions(_ranked(spark, sf_dir))


@query(
    "k3_execution_order",
    with_views(
        ["v_steps"],
        _SCORED
        + """, ring AS (SELECT *, step_id % 8 AS r, arg_min(step_id, rank) OVER w AS start, min(rank) OVER w AS first_rank FROM ranked WINDOW w AS (PARTITION BY report_id, step_id % 8))
SELECT report_id, step_id, row_number() OVER (PARTITION BY report_id ORDER BY first_rank, ((step_id - start) // 8 + 5) % 5 DESC) AS position FROM ring""",
    ),
)
def execution_order(spark, sf_dir):
    """Rings of five steps, each needing the next, an unknown one and one twice: a ring unwinds from its best step."""
    base = F.col("report_id") * 40
    need = base + (F.col("step_id") - base + 8) % 40
    needs = F.array(F.lit(-1).cast("bigint"), need, need)
    return runbooks.execution_order(_ranked(spark, sf_dir).withColumn("dependencies", needs))
