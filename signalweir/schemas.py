"""Table shapes the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_MAP = T.MapType(_S, _S)

ALERT_BODY = _struct(
    alerts=T.ArrayType(_struct(status=_S, labels=_MAP, annotations=_MAP)),
    labels=_MAP, annotations=_MAP, tags=_S,
    source=_S, service=_S, entity=_S, host=_S,
    severity=_S, alert_type=_S, priority=_S, level=_S,
    status=_S, state=_S, alert_transition=_S,
    title=_S, alertname=_S, body=_S, message=_S,
)

SIGNALS = _struct(
    signal_id=_L, tenant_id=_S, source=_S, entity=_S, severity=_S, title=_S, message=_S,
    state=_S, breached=_B, created_at=_TS,
)

MITIGATION_STEP = _struct(action=_S, cliCommand=_S)
SCORED_STEP = _struct(
    id=_S, action=_S, cliCommand=_S, stepType=_S, compositeScore=_L, rank=_L, recoveryTimeMinutes=_D,
    blastRadius=_I, reversibility=_S, evidenceQuality=_S, confidence=_S,
)
REPORT_PAYLOAD = _struct(
    incidentFingerprint=_struct(
        executiveSummary=_S, primaryFailingComponent=_S, severityLevel=_S, historicalCorrelation=_S
    ),
    rootCauseAnalysis=_struct(definitiveRootCause=_S, evidenceCitations=T.ArrayType(_S)),
    diagnosticReasoning=T.ArrayType(_struct(observation=_S, deduction=_S)),
    actionableRunbook=_struct(mitigationSteps=T.ArrayType(MITIGATION_STEP)),
    confidenceMatrix=_struct(overallScore=_D, missingTelemetry=T.ArrayType(_S)),
)
SCORED_RUNBOOK = _struct(scoredSteps=T.ArrayType(SCORED_STEP))

DOCUMENTS = _struct(
    document_id=_L, tenant_id=_S, collection=_S, title=_S, source_uri=_S, content=_S, content_hash=_S,
    status=_S, chunk_count=_L, version=_L, error=_S, created_at=_TS,
)
CHUNKS = _struct(
    chunk_id=_L, document_id=_L, tenant_id=_S, collection=_S, chunk_index=_L, content=_S, heading=_S,
    token_estimate=_L, embedding=T.ArrayType(T.FloatType()),
)
GRAPH_NODES = _struct(tenant_id=_S, component=_S, incident_count=_L)
GRAPH_EDGES = _struct(tenant_id=_S, from_node=_S, to_node=_S, occurrence_count=_L, last_seen_at=_TS)
HYPOTHESES = _struct(incident_id=_S, position=_L, hypothesis=_S, prior=_D, component=_S, evidence=T.ArrayType(_S))
VOTES = _struct(incident_id=_S, voter=_S, hypothesis_id=_S, prior=_D)
RUNBOOK_STEPS = _struct(
    report_id=_S, step_id=_S, step_type=_S, success_probability=_D, root_cause_probability=_D,
    decision_value=_D, recovery_minutes=_D, blast_radius=_I, reversibility=_S, evidence_quality=_S,
    confidence=_S, dependencies=T.ArrayType(_S),
)
