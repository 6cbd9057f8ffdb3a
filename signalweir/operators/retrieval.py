"""Retrieval over a chunk corpus, for many questions at once.

Questions: query_id, tenant_id, collection, query_text, embedding.
Chunks: chunk_id, document_id, tenant_id, collection, title, heading, content, embedding.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweir.functions.text import lexical_overlap, query_terms, term_set_similarity
from signalweir.functions.vectors import hybrid_score
from signalweir.operators.merge import latest_rows
from signalweir.scale import fits, top_per_key
from signalweir.session import settle

CANDIDATES = 20
TOP_K = 5
RRF_K0 = 60
ALPHA = 0.7
LAMBDA = 0.7
BROADCAST_QUERIES = 4096
BROADCAST_FOUND = 200_000
BLOCK_ITEMS = 20_000
PLACE = ["tenant_id", "collection"]
#: By how much sums of a matrix product may differ from those of a pair at a time.
SLACK = 1e-12
MEMORY_K = 3
MEMORY_FLOOR = 0.70

Scorer = Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame]


def _best(scores: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a query by item matrix that may be among the k best of their query."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero((scores >= kth[:, None] - SLACK) & (scores > floor))
    return np.nonzero(scores > floor)


def _ranked(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best items of each query, score descending, id ascending."""
    found = pd.DataFrame({"query_id": query_ids, "item_id": ids, "score": scores})
    found = found.sort_values(["score", "item_id"], ascending=[False, True], kind="stable")
    return found[found.groupby("query_id").cumcount() < k]


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one, a row each; NaN for those without a length, with nulls, or of another length than most."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    size = Counter(map(len, rows)).most_common(1)[0][0]
    m = np.stack([r if len(r) == size else np.full(size, np.nan) for r in rows])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def cosine_scorer(exclude_same_id: bool = False) -> Scorer:
    def score(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
        asked, held = _unit(queries["payload"]), _unit(items["payload"])
        if asked.shape[1] != held.shape[1]:
            raise ValueError(f"vectors of {asked.shape[1]} and of {held.shape[1]} numbers")
        sims = asked @ held.T
        np.nan_to_num(sims, copy=False, nan=-np.inf)
        ids, query_ids = items["item_id"].to_numpy(), queries["query_id"].to_numpy()
        if exclude_same_id:
            sims[query_ids[:, None] == ids[None, :]] = -np.inf
        q, i = _best(sims, k, -np.inf)
        # summed a pair at a time, so that equal vectors have equal cosines wherever they lie in the matrix
        exact = np.concatenate([(asked[q[s : s + 65536]] * held[i[s : s + 65536]]).sum(axis=1) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        return _ranked(query_ids[q], ids[i], exact, k)

    return score


def _like(term: str) -> re.Pattern:
    parts = re.findall(r"\\.|.", term, re.S)
    wild = {"%": ".*", "_": "."}
    return re.compile("".join(wild.get(p) or re.escape(p[-1]) for p in parts), re.S)


def _keyword_score(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """Hits of a query on an item: how many of its terms the text contains (LIKE wildcards count)."""
    import ahocorasick

    askers: dict[str, list[int]] = {}
    for i, terms in enumerate(queries["payload"]):
        for term in terms:
            askers.setdefault(term, []).append(i)
    wild = {t: _like(t) for t in askers if any(c in t for c in "%_\\")}
    plain = ahocorasick.Automaton()
    for term in askers.keys() - wild.keys():
        plain.add_word(term, term)
    if len(plain):
        plain.make_automaton()
    asking = {term: np.array(at) for term, at in askers.items()}
    # a row for each item: its counts lie beside each other while they are added up
    hits = np.zeros((len(items), len(queries)), dtype=np.float64)
    for row, text in zip(hits, items["payload"]):
        low = text.lower()
        seen = {term for _, term in plain.iter(low)} if len(plain) else set()
        seen.update(term for term, like in wild.items() if like.search(low))
        for term in seen:
            row[asking[term]] += 1
    hits = hits.T
    q, i = _best(hits, k, 0.0)
    return _ranked(queries["query_id"].to_numpy()[q], items["item_id"].to_numpy()[i], hits[q, i], k)


def _dealt(rows: DataFrame, place: Sequence[str], item: str, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """`rows` with a block of their group by a hash of `item`, once for every block of the other side."""
    cut = rows.join(sizes, [F.col(p) == F.col(f"_{p}") for p in place])
    return cut.select(
        *[F.col(p).alias(f"{own}_{p}") for p in place],
        F.pmod(F.xxhash64(item), F.col(own)).alias(f"{own}_{own}"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{own}_{other}"),
        item, "payload",
    )


def block_top_k(
    queries: DataFrame, items: DataFrame, scorer: Scorer, k: int, place: Sequence[str] = PLACE, total: int | None = None
) -> DataFrame:
    """Exact k best items per query within `place`, without emitting pairs: query_id, item_id, score, rank.

    Each block of items keeps only its own k best per query; a window merges the blocks.
    Few queries (their number is checked) are broadcast and items are scanned where they lie.
    Beyond that, both sides of a group are cut into hashed blocks, as many as its size asks
    for, and every pair of blocks meets in one task, whose size does not depend on the size
    of the group. Rows without a place meet nothing. Of a query's blocks together the `total`
    best rows are kept, k without it.
    """
    place = list(place)
    queries, items = (side.dropna(subset=place) for side in (queries, items))
    qid = queries.schema["query_id"].dataType.simpleString()
    iid = items.schema["item_id"].dataType.simpleString()
    out = f"query_id {qid}, item_id {iid}, score double"
    empty = pd.DataFrame({"query_id": [], "item_id": [], "score": []})

    held = queries.limit(BROADCAST_QUERIES + 1).toPandas()
    if len(held) <= BROADCAST_QUERIES:
        groups = {g: part.reset_index(drop=True) for g, part in held.groupby(place)} if len(held) else {}
        shared = queries.sparkSession.sparkContext.broadcast(groups)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for group, part in batch.groupby(place):
                    asked = shared.value.get(group)
                    if asked is None:
                        continue
                    step = max(1, 4_000_000 // len(asked))
                    for at in range(0, len(part), step):
                        yield scorer(asked, part.iloc[at : at + step], k)

        scored = items.mapInPandas(scan, out)
    else:
        asked, held_by = (
            side.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias(name)) for side, name in ((queries, "q"), (items, "i"))
        )
        sizes = settle(asked.join(held_by, place).select(*[F.col(p).alias(f"_{p}") for p in place], "q", "i"))
        # both sides may be the same table: their columns get names of their own
        q, i = _dealt(queries, place, "query_id", sizes, "q", "i"), _dealt(items, place, "item_id", sizes, "i", "q")

        def meet(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or part.empty:
                return empty
            step = max(1, 4_000_000 // len(part))
            return pd.concat([scorer(asked.iloc[at : at + step], part, k) for at in range(0, len(asked), step)])

        keys = [*place, "q", "i"]
        one, two = q.groupBy(*[f"q_{c}" for c in keys]), i.groupBy(*[f"i_{c}" for c in keys])
        scored = one.cogroup(two).applyInPandas(meet, out)
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id").asc()], total or k)


def semantic_search(questions: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """query_id, chunk_id, similarity, rank (1-based): exact nearest chunks by cosine."""
    place = ["tenant_id", "collection"]
    q = questions.where("embedding IS NOT NULL").select("query_id", *place, F.col("embedding").alias("payload"))
    c = chunks.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("item_id"), *place, F.col("embedding").alias("payload"))
    best = block_top_k(q, c, cosine_scorer(False), k)
    return best.select("query_id", F.col("item_id").alias("chunk_id"), F.col("score").alias("similarity"), "rank")


def keyword_search(questions: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """query_id, chunk_id, hits, rank (1-based): chunks that contain most of the question's terms."""
    place = ["tenant_id", "collection"]
    terms = query_terms(F.col("query_text"))
    q = questions.select("query_id", *place, terms.alias("payload")).where(F.size("payload") > 0)
    c = chunks.select(F.col("chunk_id").alias("item_id"), *place, F.col("content").alias("payload"))
    best = block_top_k(q, c, _keyword_score, k)
    return best.select("query_id", F.col("item_id").alias("chunk_id"), F.col("score").cast("bigint").alias("hits"), "rank")


def reciprocal_rank_fusion(ranked: DataFrame, k0: int = RRF_K0) -> DataFrame:
    """Fuse ranked lists: query_id, list_no, rank (1-based), chunk_id; one row per chunk.

    A `similarity` column is carried along from whichever list knows it.  Ties keep the order in which the lists, read one after the other, first show the chunk.
    """
    part = F.lit(1.0) / (F.lit(k0) + F.col("rank") - 1)
    return (
        ranked.where(F.col("chunk_id").isNotNull())
        .groupBy("query_id", "chunk_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("list_no", part.alias("p")))).alias("_parts"),
            F.min(F.struct("list_no", "rank")).alias("first_seen"),
            *([F.max("similarity").alias("similarity")] if "similarity" in ranked.columns else []),
        )
        .withColumn("rrf", F.aggregate("_parts", F.lit(0.0), lambda s, e: s + e["p"]))
        .drop("_parts")
    )


def fused_top(fused: DataFrame, k: int = CANDIDATES) -> DataFrame:
    return top_per_key(fused, ["query_id"], [F.col("rrf").desc(), F.col("first_seen").asc()], k)


def mmr_rerank(
    questions: DataFrame, candidates: DataFrame, k: int = TOP_K, alpha: float = ALPHA, lam: float = LAMBDA
) -> DataFrame:
    """Greedy relevance-and-novelty pick per query, as a fold inside the JVM.

    `candidates`: query_id, chunk_id, content, similarity, rank.  A query brings its candidate
    pool (at most 20 rows) and nothing else into one row.
    """
    q = questions.select("query_id", query_terms(F.col("query_text")).alias("_q"))
    scored = (
        candidates.join(q, "query_id")
        .withColumn("_tokens", query_terms(F.col("content")))
        .withColumn("lexical", lexical_overlap(F.col("_q"), F.col("_tokens")).cast("double"))
        .withColumn("score", hybrid_score(F.col("similarity"), F.col("lexical"), alpha))
    )
    entry = F.struct("rank", "chunk_id", "similarity", "lexical", "score", F.col("_tokens").alias("terms"))
    pools = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("pool"))

    # the fold keeps, per candidate, its likeness to the closest pick so far: a turn compares
    # the free candidates with the newest pick only
    def step(state: Column, _turn: Column) -> Column:
        taken, worst = state["taken"], state["worst"]
        valued = F.transform(
            worst,
            lambda w, i: F.struct(
                (F.get("pool", i)["score"] * lam - w * (1 - lam)).alias("value"), (-i).alias("order")
            ),
        )
        free = F.filter(valued, lambda v: ~F.exists(taken, lambda t: t["index"] == -v["order"]))
        best = F.array_max(free)
        picked = F.struct((-best["order"]).alias("index"), best["value"].alias("value"))
        return F.when(F.size(free) == 0, state).otherwise(
            F.struct(F.concat(taken, F.array(picked)).alias("taken"), compared(worst, -best["order"]).alias("worst"))
        )

    def compared(worst: Column, newest: Column) -> Column:
        return F.element_at(
            F.transform(
                F.array(newest),
                lambda at: F.transform(
                    worst,
                    lambda w, i: F.greatest(
                        w, term_set_similarity(F.get("pool", at)["terms"], F.get("pool", i)["terms"])
                    ),
                ),
            ),
            1,
        )

    start = F.struct(
        F.array().cast("array<struct<index:int,value:double>>").alias("taken"),
        F.transform("pool", lambda _c: F.lit(0.0)).alias("worst"),
    )
    picks = pools.withColumn("picks", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["taken"]))
    rows = picks.select("query_id", "pool", F.posexplode("picks").alias("pos", "pick"))
    got = F.get("pool", F.col("pick.index"))
    return rows.select(
        "query_id",
        got["chunk_id"].alias("chunk_id"),
        (F.col("pos") + 1).cast("bigint").alias("position"),
        got["similarity"].alias("similarity"),
        got["lexical"].alias("lexical"),
        got["score"].alias("score"),
        F.col("pick.value").alias("rerank_score"),
    )


def _look_up(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join a result list with its chunks.  The list (k rows a question) is settled, so the search
    behind it runs once; when its counted size is small it is broadcast and the corpus stays put."""
    found = settle(found)
    small = fits(found, BROADCAST_FOUND)
    return chunks.join(F.broadcast(found) if small else found, "chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, pool: int = CANDIDATES, **weights: float) -> DataFrame:
    """Nearest chunks, reranked."""
    found = semantic_search(questions, chunks, pool).select("query_id", "chunk_id", "similarity", "rank")
    return mmr_rerank(questions, _look_up(found, chunks.select("chunk_id", "content")), k, **weights)


def hybrid_candidates(questions: DataFrame, chunks: DataFrame, pool: int = CANDIDATES) -> DataFrame:
    """Both arms fused; the cosine is carried where the semantic arm saw the chunk, else 0."""
    semantic = semantic_search(questions, chunks, pool)
    keyword = keyword_search(questions, chunks, pool)
    unknown = F.lit(None).cast("double").alias("similarity")
    lists = semantic.select("query_id", "chunk_id", "rank", F.lit(0).alias("list_no"), "similarity").unionByName(
        keyword.select("query_id", "chunk_id", "rank", F.lit(1).alias("list_no"), unknown)
    )
    fused = fused_top(reciprocal_rank_fusion(lists), pool)
    return fused.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def retrieve_hybrid(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, pool: int = CANDIDATES, **weights: float) -> DataFrame:
    """Semantic and keyword arms, fused by rank, reranked."""
    found = hybrid_candidates(questions, chunks, pool).select("query_id", "chunk_id", "similarity", "rank")
    return mmr_rerank(questions, _look_up(found, chunks.select("chunk_id", "content")), k, **weights)


def cited_blocks(hits: DataFrame, chunks: DataFrame, max_chars: int = 6000, min_score: float = 0.35) -> DataFrame:
    """Numbered source blocks under a character budget, best first; the first always fits."""
    about = chunks.select("chunk_id", "document_id", "title", "heading", "content")
    titled = F.col("title").isNotNull() & (F.col("title") != "")
    headed = F.col("heading").isNotNull() & (F.col("heading") != "")
    label = (
        F.when(titled & headed, F.concat_ws(" › ", "title", "heading"))
        .when(titled, F.col("title"))
        .when(headed, F.col("heading"))
        .otherwise(F.lit("untitled"))
    )
    w = Window.partitionBy("query_id").orderBy("position")
    good = hits.where(F.col("score") >= min_score).select("query_id", "chunk_id", "position", "score")
    body = _look_up(good, about).withColumn("ref", F.row_number().over(w).cast("bigint"))
    block = F.concat(F.lit("[["), F.col("ref").cast("string"), F.lit("]] "), label, F.lit("\n"), F.col("content"))
    used = F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        body.withColumn("block", block)
        .withColumn("_used", used)
        .where((F.col("ref") == 1) | (F.col("_used") <= max_chars))
        .select("query_id", "ref", "document_id", "title", "heading", F.round("score", 3).alias("score"), "block")
    )


def pack_context(blocks: DataFrame) -> DataFrame:
    """One context text per question from its cited blocks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ref", "block"))), lambda e: e["block"])
    return blocks.groupBy("query_id").agg(
        F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("sources")
    )


# --- incident memory ---


def latest_embeddings(rows: DataFrame) -> DataFrame:
    """Latest embedding per incident; rows without a vector never overwrite one."""
    return latest_rows(rows.where("embedding IS NOT NULL"), ["incident_id"], [F.col("created_at"), F.col("report_id")])


def similar_incidents(
    current: DataFrame, memory: DataFrame, k: int = MEMORY_K, min_similarity: float = MEMORY_FLOOR
) -> DataFrame:
    """The k nearest other incidents of the tenant, then a similarity floor (fewer than k may pass).

    Both frames: tenant_id, incident_id, embedding.
    """
    one = F.lit("incidents").alias("collection")
    q = current.where("embedding IS NOT NULL").select(
        F.col("incident_id").alias("query_id"), "tenant_id", one, F.col("embedding").alias("payload")
    )
    m = memory.where("embedding IS NOT NULL").select(
        F.col("incident_id").alias("item_id"), "tenant_id", one, F.col("embedding").alias("payload")
    )
    best = block_top_k(q, m, cosine_scorer(True), k).where(F.col("score") >= min_similarity)
    return best.select(
        F.col("query_id").alias("incident_id"),
        F.col("item_id").alias("similar_incident_id"),
        F.col("score").alias("similarity"),
        "rank",
    )
