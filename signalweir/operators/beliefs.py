"""Beliefs over hypothesis sets, and pooling them over voters.

Beliefs are long tables: incident_id, hypothesis_id, prior; votes add a voter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions.text import strip_ws
from signalweir.functions.beliefs import hypothesis_prior, hypothesis_text, hypothesis_key, usable_prior
from signalweir.operators.matching import names_in_texts
from signalweir.scale import top_per_key
from signalweir.session import settle

MAX_HYPOTHESES = 6
MIN_PRIOR = 0.01
MIN_LEADER = 0.4
MIN_LEAD = 0.15
EPSILON = 1e-3
MAX_ITERATIONS = 500
SILENT_AGREEMENT = 0.01
#: Voter graphs of so many voters are solved as matrices.
DENSE_VOTERS = 256


def parse_answers(answers: DataFrame) -> DataFrame:
    """Raw items of model answers: incident_id, position, hypothesis, prior, component, evidence.

    `answers`: incident_id, answer (a JSON array of strings or objects).  What is no array gives
    no items; an item without a text stays with a null hypothesis, which normalising leaves out.
    """
    items = F.try_variant_get(F.try_parse_json("answer"), "$", "array<variant>")
    rows = answers.select("incident_id", F.posexplode(items).alias("position", "_v"))
    text = F.to_json("_v")
    return rows.select(
        "incident_id", F.col("position").cast("bigint").alias("position"), hypothesis_text(text).alias("hypothesis"),
        hypothesis_prior(text).alias("prior"), F.try_variant_get("_v", "$.component", "string").alias("component"),
        F.try_variant_get("_v", "$.evidence", "array<string>").alias("evidence"),
    )


def normalize_hypotheses(raw: DataFrame) -> DataFrame:
    """A clean distribution per incident from raw items: incident_id, position, hypothesis, prior.

    Restated hypotheses collapse to the first; one missing prior makes all uniform; the six
    best with at least 1 % each are kept, renormalised and numbered H1...
    """
    text = raw.withColumn("hypothesis", strip_ws(F.col("hypothesis"))).where("hypothesis <> ''")
    text = text.withColumn("prior", usable_prior(F.col("prior")))
    first = (
        text.groupBy("incident_id", hypothesis_key(F.col("hypothesis")).alias("_key"))
        .agg(F.min(F.struct("position", "hypothesis", "prior")).alias("_f"))
        .select("incident_id", "_f.*")
    )
    mass = first.groupBy("incident_id").agg(
        F.count("*").alias("_n"), F.count("prior").alias("_weighted"), F.sum("prior").alias("_total")
    )
    uniform = F.col("_n") != F.col("_weighted")
    spread = first.join(mass, "incident_id").withColumn(
        "prior", F.when(uniform, F.lit(1.0) / F.col("_n")).otherwise(F.col("prior") / F.col("_total"))
    )
    best = top_per_key(
        spread.select("incident_id", "position", "hypothesis", "prior"),
        ["incident_id"], [F.col("prior").desc(), F.col("position").asc()], MAX_HYPOTHESES,
    ).where(F.col("prior") >= MIN_PRIOR)
    kept = best.groupBy("incident_id").agg(F.sum("prior").alias("_kept"))
    return best.join(kept, "incident_id").select(
        "incident_id",
        F.concat(F.lit("H"), F.col("rank").cast("string")).alias("hypothesis_id"),
        "hypothesis",
        (F.col("prior") / F.col("_kept")).alias("prior"),
        "rank",
        "position",
    )


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def entropy(beliefs: DataFrame) -> DataFrame:
    """Entropy in nats, and as a share of its maximum, per incident."""
    h = beliefs.groupBy("incident_id").agg(F.sum(_plogp(F.col("prior"))).alias("entropy"), F.count("*").alias("hypotheses"))
    share = F.when(F.col("hypotheses") > 1, F.col("entropy") / F.ln("hypotheses")).otherwise(F.lit(0.0))
    return h.withColumn("uncertainty", share)


def belief_summary(beliefs: DataFrame, order: str = "hypothesis_id") -> DataFrame:
    """Uncertainty, leader (first maximum by `order`) and whether the lead is decisive."""
    top = top_per_key(beliefs, ["incident_id"], [F.col("prior").desc(), F.col(order).asc()], 2, "_rank")
    lead = top.groupBy("incident_id").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("hypothesis_id"))).alias("leading_id"),
        F.max(F.when(F.col("_rank") == 1, F.col("prior"))).alias("leading_prior"),
        F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("prior"))), F.lit(0.0)).alias("_second"),
    )
    decisive = (F.col("leading_prior") >= MIN_LEADER) & (F.col("leading_prior") - F.col("_second") >= MIN_LEAD)
    return entropy(beliefs).join(lead.withColumn("decisive", decisive).drop("_second"), "incident_id")


def attach_details(beliefs: DataFrame, raw: DataFrame, max_evidence: int = 3) -> DataFrame:
    """Component and first evidence lines of each hypothesis, matched on its exact text (last entry wins)."""
    about = raw.groupBy("incident_id", "hypothesis").agg(
        F.max_by(F.struct("component", "evidence"), "position").alias("_d")
    )
    return beliefs.join(about, ["incident_id", "hypothesis"], "left").select(
        beliefs["*"], F.col("_d.component").alias("component"), F.slice("_d.evidence", 1, max_evidence).alias("evidence")
    )


# --- voters ---


def graph_vote(hypotheses: DataFrame, nodes: DataFrame) -> DataFrame:
    """The history voter: 1 + the largest incident count of a node that contains the component or is contained in it.

    `hypotheses`: incident_id, tenant_id, hypothesis_id, hypothesis, component, rank.
    `nodes`: tenant_id, component, incident_count.  Incidents that name no component, whose
    tenant has no history, or whose scores do not differ, abstain (no rows).
    """
    low = settle(hypotheses.withColumn("_c", F.lower("component")))
    asked = low.where("_c <> ''").select("tenant_id", F.col("_c").alias("name")).distinct()
    history = (
        nodes.select("tenant_id", F.lower("component").alias("name"), F.col("incident_count").cast("bigint").alias("n"))
        .groupBy("tenant_id", "name")
        .agg(F.max("n").alias("n"))
    )
    inside = names_in_texts(asked.withColumnRenamed("name", "key"), history, ["tenant_id", "key"], "key")
    inside = inside.join(history, ["tenant_id", "name"]).select("tenant_id", F.col("key").alias("_c"), "n")
    around = names_in_texts(
        history.withColumnRenamed("name", "node"), asked, ["tenant_id", "n"], "node", largest="n"
    ).select("tenant_id", F.col("name").alias("_c"), "n")
    # a row per name asked for; what follows reads it several times
    best = settle(inside.unionByName(around).groupBy("tenant_id", "_c").agg(F.max("n").alias("_best")))
    known = history.select("tenant_id").distinct()
    scored = (
        low.join(known, "tenant_id", "left_semi")
        .join(best, ["tenant_id", "_c"], "left")
        .withColumn("score", 1 + F.coalesce("_best", F.lit(0)))
    )
    useful = scored.groupBy("incident_id").agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.when(F.col("_c") != "", 1)).alias("_named")
    ).where("_lo < _hi AND _named > 0")
    voting = scored.join(useful.select("incident_id"), "incident_id", "left_semi")
    clean = normalize_hypotheses(
        voting.select("incident_id", F.col("rank").alias("position"), "hypothesis", F.col("score").cast("double").alias("prior"))
    )
    ids = hypotheses.select("incident_id", F.col("rank").alias("position"), "hypothesis_id")
    return clean.drop("hypothesis_id").join(ids, ["incident_id", "position"]).select(
        "incident_id", F.lit("graph").alias("voter"), "hypothesis_id", "prior"
    )


def clean_votes(votes: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Keep votes on known hypotheses with a usable prior; a voter left with fewer than two abstains."""
    known = hypotheses.select("incident_id", "hypothesis_id").distinct()
    usable = votes.withColumn("prior", usable_prior(F.col("prior").cast("double"))).where("prior IS NOT NULL")
    usable = usable.join(known, ["incident_id", "hypothesis_id"], "left_semi")
    mass = usable.groupBy("incident_id", "voter").agg(F.sum("prior").alias("_total"), F.count("*").alias("_n")).where("_n >= 2")
    return usable.join(mass, ["incident_id", "voter"]).select(
        "incident_id", "voter", "hypothesis_id", (F.col("prior") / F.col("_total")).alias("prior")
    )


def align_votes(votes: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Every voter on every hypothesis of its incident; missing is 0, an empty row is uniform."""
    ids = hypotheses.select("incident_id", "hypothesis_id").distinct()
    size = ids.groupBy("incident_id").agg(F.count("*").alias("_m"))
    grid = votes.select("incident_id", "voter").distinct().join(ids, "incident_id")
    given = votes.groupBy("incident_id", "voter", "hypothesis_id").agg(F.max("prior").alias("prior"))
    rows = grid.join(given, ["incident_id", "voter", "hypothesis_id"], "left").withColumn(
        "prior", F.greatest(F.coalesce(F.col("prior").cast("double"), F.lit(0.0)), F.lit(0.0))
    )
    mass = rows.groupBy("incident_id", "voter").agg(F.sum("prior").alias("_total"))
    return (
        rows.join(mass, ["incident_id", "voter"])
        .join(size, "incident_id")
        .select(
            "incident_id", "voter", "hypothesis_id",
            F.when(F.col("_total") > 0, F.col("prior") / F.col("_total")).otherwise(F.lit(1.0) / F.col("_m")).alias("prior"),
        )
    )


def linear_pool(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("incident_id", "hypothesis_id").agg(F.avg("prior").alias("prior"))


def _kl_term(p: Column, q: Column) -> Column:
    return F.when(p <= 0, F.lit(0.0)).when(q <= 0, F.lit(float("inf"))).otherwise(p * F.ln(p / q))


def divergence(aligned: DataFrame, pooled: DataFrame) -> DataFrame:
    """KL of each voter from the pool, in nats."""
    bar = pooled.select("incident_id", "hypothesis_id", F.col("prior").alias("_bar"))
    return (
        aligned.join(bar, ["incident_id", "hypothesis_id"])
        .groupBy("incident_id", "voter")
        .agg(F.sum(_kl_term(F.col("prior"), F.col("_bar"))).alias("kl"))
    )


def pool_beliefs(aligned: DataFrame, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(pooled, report) when every voter hears every other.

    On the complete graph with step 1/n one averaging step lands on the mean, so no loop is
    needed: a set of voters further apart than epsilon takes one iteration, any other none.
    """
    pooled = linear_pool(aligned)
    spread = divergence(aligned, pooled).groupBy("incident_id").agg(
        F.count("*").alias("voters"), F.max("kl").alias("initial_disagreement")
    )
    single = F.col("voters") == 1
    moved = ~single & (F.col("initial_disagreement") >= epsilon)
    zero = F.lit(0.0)
    report = spread.select(
        "incident_id",
        "voters",
        F.when(single, zero).otherwise(F.col("initial_disagreement")).alias("initial_disagreement"),
        moved.cast("int").alias("iterations"),
        F.when(moved | single, zero).otherwise(F.col("initial_disagreement")).alias("final_disagreement"),
        single.alias("single_agent"),
        F.lit(True).alias("converged"),
        F.when(single, zero).otherwise(F.lit(1.0) / F.col("voters")).alias("alpha"),
        F.when(single, zero).otherwise(F.col("voters").cast("double")).alias("fiedler"),
    )
    return pooled, report


def pool_beliefs_on_graph(
    aligned: DataFrame, links: DataFrame, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pooled, per_voter, report) when voters hear only their neighbours.

    `links`: incident_id, voter_a, voter_b, weight, each pair in both directions.  All incidents
    step together; one that agrees to epsilon leaves the loop.  Each round is one join and a few
    partial aggregates over the incidents still moving, settled so the plan stays flat.
    """
    place = ["incident_id", "voter", "hypothesis_id"]
    links = links.where(F.col("voter_a") != F.col("voter_b"))
    degree = links.groupBy("incident_id", F.col("voter_a").alias("voter")).agg(F.sum("weight").alias("_deg"))
    step = degree.groupBy("incident_id").agg(F.max("_deg").alias("_max")).select(
        "incident_id", F.when(F.col("_max") > 0, 1 / (F.col("_max") + 1)).otherwise(F.lit(0.0)).alias("alpha")
    )
    links = settle(links.join(step, "incident_id"))
    state = settle(aligned.select(*place, "prior"))
    initial = state
    finished: DataFrame | None = None
    counts: DataFrame | None = None
    for turn in range(max_iterations + 1):
        worst = divergence(state, linear_pool(state)).groupBy("incident_id").agg(F.max("kl").alias("_kl"))
        marked = settle(state.join(worst, "incident_id").withColumn("_done", F.col("_kl") < epsilon))
        still = ~F.col("_done") if turn < max_iterations else F.lit(False)
        rest = marked.where(~still)
        finished = rest.select(*place, "prior") if finished is None else finished.unionByName(rest.select(*place, "prior"))
        told = rest.select("incident_id", F.lit(turn).alias("iterations"), (F.col("_done") & F.lit(turn < max_iterations)).alias("converged")).distinct()
        counts = told if counts is None else counts.unionByName(told)
        moving = marked.where(still).select(*place, "prior")
        if turn == max_iterations or moving.isEmpty():
            break
        heard = moving.select(
            "incident_id", F.col("voter").alias("voter_b"), "hypothesis_id", F.col("prior").alias("_theirs")
        )
        pull = (
            moving.join(links.withColumnRenamed("voter_a", "voter"), ["incident_id", "voter"])
            .join(heard, ["incident_id", "voter_b", "hypothesis_id"])
            .groupBy(*place)
            .agg(F.sum(F.col("alpha") * F.col("weight") * (F.col("_theirs") - F.col("prior"))).alias("_pull"))
        )
        state = settle(
            moving.join(pull, place, "left").select(*place, (F.col("prior") + F.coalesce("_pull", F.lit(0.0))).alias("prior"))
        )
    pooled = linear_pool(finished)
    before = divergence(initial, linear_pool(initial)).withColumnRenamed("kl", "initial_kl")
    after = divergence(finished, pooled).withColumnRenamed("kl", "final_kl")
    per_voter = before.join(after, ["incident_id", "voter"])
    report = per_voter.groupBy("incident_id").agg(
        F.count("*").alias("voters"),
        F.max("initial_kl").alias("initial_disagreement"),
        F.max("final_kl").alias("final_disagreement"),
    ).join(counts, "incident_id")
    return pooled, per_voter, report


def algebraic_connectivity(
    voters: DataFrame, links: DataFrame, dense_voters: int = DENSE_VOTERS, rounds: int = 200, tolerance: float = 1e-9
) -> DataFrame:
    """incident_id, voters, fiedler: the second-smallest eigenvalue of each incident's voter graph.

    `voters`: incident_id, voter; `links` as in `pool_beliefs_on_graph`; weights of repeated
    links add up, links of or to unknown voters and to oneself count for nothing.  Zero says
    that a graph falls apart, n that all n voters hear one another.  Null ids are left out; an incident
    of one voter has 0.  Graphs of up to `dense_voters` are solved as matrices, each in the one
    task that holds its links (a bounded number: pairs are summed first); larger ones by power
    iteration on tables, which approaches the value from above and ends within `rounds`.
    """
    known = voters.select("incident_id", "voter").where("incident_id IS NOT NULL AND voter IS NOT NULL").distinct()
    sizes = known.groupBy("incident_id").agg(F.count("*").alias("voters"))
    ends = [known.withColumnRenamed("voter", f"voter_{x}") for x in "ab"]
    pairs = (
        links.where("voter_a <> voter_b")
        .groupBy("incident_id", "voter_a", "voter_b")
        .agg(F.sum("weight").cast("double").alias("weight"))
        .join(ends[0], ["incident_id", "voter_a"], "left_semi")
        .join(ends[1], ["incident_id", "voter_b"], "left_semi")
        .join(sizes, "incident_id")
    )
    small = pairs.where(F.col("voters") <= dense_voters).groupBy("incident_id").applyInPandas(
        _dense_fiedler, f"incident_id {known.schema['incident_id'].dataType.simpleString()}, fiedler double"
    )
    big = settle(pairs.where(F.col("voters") > dense_voters).drop("voters"))
    if not big.isEmpty():
        small = small.unionByName(_iterated_fiedler(known, big, rounds, tolerance))
    # an incident without links falls apart
    return sizes.join(small, "incident_id", "left").withColumn("fiedler", F.coalesce("fiedler", F.lit(0.0)))


def _dense_fiedler(pairs: pd.DataFrame) -> pd.DataFrame:
    names, at = np.unique(np.concatenate([pairs.voter_a, pairs.voter_b]), return_inverse=True)
    n = int(pairs.voters.iloc[0])
    weights = np.zeros((n, n))
    np.add.at(weights, (at[: len(pairs)], at[len(pairs) :]), pairs.weight.to_numpy())
    weights = (weights + weights.T) / 2
    value = np.linalg.eigvalsh(np.diag(weights.sum(axis=1)) - weights)[1]
    return pd.DataFrame({"incident_id": [pairs.incident_id.iloc[0]], "fiedler": [max(0.0, float(value))]})


def _iterated_fiedler(voters: DataFrame, links: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """Power iteration on cI - L with the constant direction taken out; a round is one join and two aggregates."""
    place = ["incident_id", "voter"]
    degree = links.groupBy("incident_id", F.col("voter_a").alias("voter")).agg(F.sum("weight").alias("_deg"))
    mine = voters.join(links.select("incident_id").distinct(), "incident_id", "left_semi")
    mine = mine.join(degree, place, "left").fillna(0.0, ["_deg"])
    shift = mine.groupBy("incident_id").agg((2 * F.max("_deg") + 1).alias("_c"))
    # any start that is not constant will do: a hash as a number around zero
    state = settle(mine.join(shift, "incident_id").withColumn("_x", F.pmod(F.xxhash64("voter"), F.lit(2000003)) / 1000001.5 - 1))
    before = None
    for turn in range(rounds):
        moments = state.groupBy("incident_id").agg(F.avg("_x").alias("_mean"), (F.stddev_pop("_x") * F.sqrt(F.count("*"))).alias("_size"))
        state = state.join(moments, "incident_id").withColumn("_x", (F.col("_x") - F.col("_mean")) / F.col("_size")).drop("_mean", "_size")
        heard = state.select("incident_id", F.col("voter").alias("voter_b"), F.col("_x").alias("_theirs"))
        pull = (
            links.join(heard, ["incident_id", "voter_b"])
            .groupBy("incident_id", F.col("voter_a").alias("voter"))
            .agg(F.sum(F.col("weight") * F.col("_theirs")).alias("_pull"))
        )
        state = state.join(pull, place, "left").withColumn("_lx", F.col("_deg") * F.col("_x") - F.coalesce("_pull", F.lit(0.0)))
        state = settle(state.drop("_pull"))
        value = settle(state.groupBy("incident_id").agg(F.greatest(F.sum(F.col("_x") * F.col("_lx")), F.lit(0.0)).alias("fiedler")))
        if before is not None:
            moved = value.join(before.withColumnRenamed("fiedler", "_was"), "incident_id")
            if moved.where(F.abs(F.col("fiedler") - F.col("_was")) > tolerance * F.greatest(F.lit(1.0), "_was")).isEmpty():
                break
        before = value
        state = state.withColumn("_x", F.col("_c") * F.col("_x") - F.col("_lx")).drop("_lx")
    return value


def disagreement(aligned: DataFrame) -> DataFrame:
    """The consensus report: pooled leader, uncertainty, decisiveness and how far apart the voters began.

    `suspicious` marks voters that never differed, the mark of a shared mistake.
    """
    pooled, report = pool_beliefs(aligned)
    return (
        belief_summary(pooled)
        .join(report, "incident_id")
        .withColumn("suspicious", ~F.col("single_agent") & (F.col("initial_disagreement") < SILENT_AGREEMENT))
    )


def voter_divergence(aligned: DataFrame) -> DataFrame:
    """incident_id, voter, initial_kl for complete-graph pooling."""
    return divergence(aligned, linear_pool(aligned)).withColumnRenamed("kl", "initial_kl")
