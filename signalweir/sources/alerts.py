"""Alert payloads: JSON text in, normalised signals and a reject table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions.signals import normalize_state
from signalweir.functions.text import first_present
from signalweir.schemas import ALERT_BODY

MAX_BODY_BYTES = 1024 * 1024


def _json(body: Column) -> Column:
    return F.try_parse_json(F.when(body == "", F.lit("{}")).otherwise(body))


def split_payloads(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) payloads: oversized and unparseable bodies go to the second."""
    reason = F.when(F.octet_length(body) > MAX_BODY_BYTES, F.lit("too-large")).when(
        _json(F.col(body)).isNull(), F.lit("invalid-json")
    )
    # a filter on a plain column would move below the body and make it again for every look at it
    marked = raw.select("*", F.explode(F.array(reason)).alias("reject_reason"))
    accepted = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, marked.where(F.col("reject_reason").isNotNull())


def parse_tags(tags: Column) -> Column:
    """Tags as a map, from ["k:v"] or from an object; a repeated key keeps its last value."""

    def by_name(pairs: Column) -> Column:
        names = F.transform(pairs, lambda t: F.substring_index(t, ":", 1))
        is_last = lambda t, i: (
            F.array_position(F.reverse(names), F.substring_index(t, ":", 1)) == F.size(names) - i
        )
        kept = F.filter(pairs, is_last)
        return F.map_from_arrays(
            F.transform(kept, lambda t: F.substring_index(t, ":", 1)),
            F.transform(kept, lambda t: t.substr(F.locate(":", t) + 1, F.length(t))),
        )

    # the text is parsed once: in a lambda its pairs are a variable
    pairs = F.filter(F.from_json(tags, "array<string>"), lambda t: F.contains(t, F.lit(":")))
    listed = F.get(F.transform(F.array(pairs), by_name), 0)
    return F.when(tags.startswith("["), listed).otherwise(F.from_json(tags, "map<string,string>"))


def _truthy(v: Column) -> Column:
    """Null when absent or empty text, else whether the JSON value counts as true."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("boolean"))
        .when(kind == "STRING", F.when(text != "", F.lit(True)))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))
        .otherwise(number != 0)
    )


def normalize_signals(raw: DataFrame, body: str = "body") -> DataFrame:
    """One normalised signal per payload; every column but `body` is carried along.

    Works the same on a static and on a streaming frame.
    """
    doc = F.from_json(F.when(F.col(body) == "", F.lit("{}")).otherwise(F.col(body)), ALERT_BODY)
    parsed = raw.withColumn("_b", doc).withColumn("_v", _json(F.col(body)))
    parsed = parsed.withColumn("_a", F.try_element_at(F.col("_b.alerts"), F.lit(1)))
    parsed = parsed.withColumn("_tags", parse_tags(F.col("_b.tags")))

    def merged(kind: str, key: str) -> Column:
        of_alert = F.col(f"_a.{kind}")
        own = F.map_contains_key(of_alert, key)
        return F.when(own, F.try_element_at(of_alert, F.lit(key))).otherwise(
            F.try_element_at(F.col(f"_b.{kind}"), F.lit(key))
        )

    def label(key: str) -> Column:
        return merged("labels", key)

    def note(key: str) -> Column:
        return merged("annotations", key)

    def field(key: str) -> Column:
        return F.col(f"_b.{key}")

    def tag(key: str) -> Column:
        return F.try_element_at(F.col("_tags"), F.lit(key))

    def raw_value(path: str) -> Column:
        return F.try_variant_get(F.col("_v"), path, "variant")

    has_alert = F.col("_b.alerts").isNotNull() & (F.size("_b.alerts") > 0)
    own_threshold = F.map_contains_key(F.col("_a.annotations"), "threshold")
    noted = F.when(own_threshold, _truthy(raw_value("$.alerts[0].annotations.threshold"))).otherwise(
        _truthy(raw_value("$.annotations.threshold"))
    )
    state = first_present(F.col("_a.status"), field("status"), field("state"), field("alert_transition"), F.lit("firing"))
    return parsed.withColumns(
        {
            "source": first_present(
                field("source"), label("source"), F.when(has_alert, F.lit("grafana")), F.lit("generic")
            ),
            "entity": first_present(
                label("service"), label("resource"), label("job"), label("instance"),
                tag("service"), tag("host"), field("service"), field("entity"), field("host"), F.lit("unknown"),
            ),
            "severity": first_present(
                label("severity"), field("severity"), field("alert_type"), field("priority"), field("level"),
                F.lit("warning"),
            ),
            "title": F.coalesce(
                first_present(label("alertname"), note("summary"), field("title"), field("alertname")), F.lit("")
            ),
            "message": F.coalesce(
                first_present(note("description"), note("summary"), field("body"), field("message")), F.lit("")
            ),
            "state": normalize_state(state),
            "breached": F.coalesce(
                _truthy(raw_value("$.breachedThreshold")),
                _truthy(raw_value("$.threshold_breached")),
                noted,
                F.lit(False),
            ),
        }
    ).drop("_a", "_b", "_v", "_tags", body)
