"""Column expressions over hypotheses: text, prior and identity of a raw model answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweir.functions.text import strip_ws


def hypothesis_text(item: Column) -> Column:
    """Text of one raw item (JSON: a string, or an object under one of three names)."""
    v = F.try_parse_json(item)
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    named = [
        F.when(
            F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING",
            F.try_variant_get(v, f"$.{n}", "string"),
        )
        for n in ("hypothesis", "rootCause", "text")
    ]
    text = strip_ws(F.coalesce(plain, *named))
    return F.when(text != "", text)


def hypothesis_prior(item: Column) -> Column:
    """Prior of one raw item; null unless it is a positive finite number."""
    v = F.try_parse_json(item)
    given = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in ("prior", "probability", "confidence")])
    return usable_prior(given.try_cast("double"))


def usable_prior(p: Column) -> Column:
    return F.when((p > 0) & ~F.isnan(p) & (p < float("inf")), p)


def hypothesis_key(text: Column) -> Column:
    """Two hypotheses with the same key say the same thing."""
    return F.trim(F.regexp_replace(F.lower(strip_ws(text)), "[^a-z0-9]+", " "))
