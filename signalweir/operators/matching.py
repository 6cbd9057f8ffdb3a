"""Which of many names occur in which of many texts, without pairing them up."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.session import settle

GRAM = 4
#: Bits of the filter that runs of the texts must pass, and bits a word of it.
FILTER_BITS, WORD = 1 << 17, 32
#: Texts, and names, of a scope that meet in one pass.
BLOCK_TEXTS, BLOCK_NAMES = 20_000, 50_000


def _grams(text: Column, size: int) -> Column:
    """Every run of `size` characters, by a look-ahead that moves one character a match."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _bit(scope: Column, gram: Column) -> Column:
    return F.pmod(F.xxhash64(scope, gram), F.lit(FILTER_BITS))


def _filter_words(wanted: DataFrame) -> tuple[list[int], list[int]]:
    """The sizes of the runs that names stand under, and a bit map of (scope, run) as numbers of WORD bits.

    Made by partial aggregates; at most FILTER_BITS / WORD rows a size reach the driver, however many the names.
    """
    bit = _bit(F.col("_scope"), F.col("_gram"))
    parts = wanted.groupBy(F.length("_gram").alias("size"), F.floor(bit / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_scope, _gram), {FILTER_BITS}) % {WORD} as int))")).alias("bits")
    )
    words, sizes = [0] * (FILTER_BITS // WORD), set()
    for row in parts.collect():
        sizes.add(row.size)
        words[row.word] |= row.bits
    return sorted(sizes), words


def names_in_texts(
    texts: DataFrame,
    names: DataFrame,
    ids: Sequence[str],
    text: str = "text",
    scope: str = "tenant_id",
    largest: str | None = None,
    unique: bool = False,
    order: str | None = None,
    shown: str | None = None,
    reach: int | None = None,
) -> DataFrame:
    """Distinct (ids, name) where the text contains the name, both of the same scope.

    A text that contains a name contains all its runs of four characters.  Each name stands
    under one of its runs, that of the least hash, so that names that begin alike are spread
    (shorter names under themselves); the runs of the texts meet the names in an equi join,
    and what meets is checked against the text.  Runs leave a text only if a bit map of the
    names' runs, of a fixed size, lets them pass; where it fills up more of them travel and
    results stay the same.  Texts travel once, next to their candidates.
    With `largest`, one of the ids: only its greatest value per name is kept.
    `unique` says that no ids repeat, so that texts need not be told apart first.
    With `reach`, at least those of a name's texts are kept that begin within so many characters
    when the texts `shown` for them stand one a line, by `order`; one of the ids is the scope.
    """
    if reach is not None:
        return _first_in_blocks(texts, names, list(ids), text, scope, order, shown, reach)
    wanted = names.select(F.col(scope).alias("_scope"), "name").where("name <> '' AND _scope IS NOT NULL").distinct()
    least = F.array_min(F.transform(_grams(F.col("name"), GRAM), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    wanted = settle(wanted.withColumn("_gram", F.when(F.length("name") > GRAM, least["g"]).otherwise(F.col("name"))))
    sizes, words = _filter_words(wanted)
    source = texts.select(*ids, F.col(scope).alias("_scope"), F.col(text).alias("_text")).where("_text <> ''")
    # equal rows share a number; should others share one too, the check below tells them apart
    source = source if unique else source.distinct()
    source = source.withColumn("_number", F.xxhash64(*ids, "_scope") if unique else F.xxhash64(*ids, "_scope", "_text"))
    passing = F.expr(f"array({', '.join(f'{w}L' for w in words)})")

    def passes(gram: Column) -> Column:
        bit = _bit(F.col("_scope"), gram)
        return F.getbit(F.get(passing, F.floor(bit / WORD).cast("int")), (bit % WORD).cast("int")) == 1

    runs = F.array_distinct(F.concat(*[F.filter(_grams(F.col("_text"), n), passes) for n in sizes or [GRAM]]))
    met = source.select("_number", "_scope", F.explode(runs).alias("_gram")).join(wanted, ["_scope", "_gram"])
    met = met.select("_number", "_scope", "name").distinct()
    found = source.join(met, ["_number", "_scope"]).where(F.contains("_text", "name"))
    if largest:
        rest = [c for c in ids if c != largest]
        return found.groupBy(*rest, "name").agg(F.max(largest).alias(largest)).select(*ids, "name")
    return found.select(*ids, "name").distinct()


def _first_in_blocks(
    texts: DataFrame, names: DataFrame, ids: list[str], text: str, scope: str, order: str, shown: str, reach: int
) -> DataFrame:
    """names_in_texts with `reach`: of each block of a scope's texts a name keeps its first ones.

    The texts and the names of a scope are cut into hashed blocks, as many as it has rows for,
    and every pair of blocks meets in one cell, where one automaton finds all names of the
    block in a pass over its texts. Small scopes share cells. A name's texts come in a block
    no earlier than among all.
    """
    names = settle(names.select(F.col(scope).alias("_scope"), "name").where("name <> '' AND _scope IS NOT NULL").distinct())
    held = texts.select(*ids, F.col(scope).alias("_scope"), F.col(text).alias("_text")).where("_text <> '' AND _scope IS NOT NULL")
    held_by = held.groupBy("_scope").agg(F.count("*").alias("_texts"), F.ceil(F.count("*") / BLOCK_TEXTS).alias("_t"))
    sizes = settle(held_by.join(names.groupBy("_scope").agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("_n")), "_scope"))
    cells = max(1, -(-(sizes.agg(F.sum(F.col("_texts") * F.col("_n"))).first()[0] or 0) // BLOCK_TEXTS))
    unit = ["_scope", "_at", "_of"]  # block of texts, block of names

    def dealt(rows: DataFrame, at: Column, of: Column) -> DataFrame:
        cut = rows.join(sizes, "_scope").withColumns({"_at": at, "_of": of}).drop("_texts", "_t", "_n")
        every = cut.withColumn("_at", F.explode("_at")).withColumn("_of", F.explode("_of"))
        return every.groupBy(F.pmod(F.xxhash64(*unit), F.lit(cells)).alias("_cell"))

    def one(hashed: str, blocks: str) -> Column:
        return F.array(F.pmod(F.xxhash64(hashed), F.col(blocks)))

    def all_of(blocks: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)

    def scan(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found = []
        wanted = {key: rows["name"].tolist() for key, rows in asked.groupby(unit)} if len(part) else {}
        for key, rows in part.sort_values(order, kind="stable").groupby(unit) if wanted else ():
            if key not in wanted:
                continue
            automaton = ahocorasick.Automaton()
            for name in wanted[key]:
                automaton.add_word(name, name)
            automaton.make_automaton()
            used: dict[str, int] = {}
            for about, size, low in zip(rows[ids].itertuples(index=False, name=None), rows[shown].str.len(), rows["_text"]):
                for name in {name for _, name in automaton.iter(low)}:
                    before = used.get(name, 0)
                    if before <= reach + 1:
                        found.append((*about, name))
                        used[name] = before + size + 1
        return pd.DataFrame(found, columns=[*ids, "name"])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ids), "name string"])
    asked, part = dealt(names, all_of("_t"), one("name", "_n")), dealt(held, one(order, "_t"), all_of("_n"))
    return asked.cogroup(part).applyInPandas(scan, schema)
