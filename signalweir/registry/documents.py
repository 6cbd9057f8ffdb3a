"""Queries over documents and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweir.functions import text as X
from signalweir.functions import vectors as V
from signalweir.operators import documents, retrieval, vector_index
from signalweir.registry.base import query, rounded
from signalweir.registry.views import table, view, with_views
from signalweir.sources.documents import accept_documents

_CHANGES = """h AS (SELECT *, sha256(content) AS content_hash FROM v_docs),
l AS (SELECT *, lag(content_hash) OVER (PARTITION BY tenant_id, collection, source_uri ORDER BY arrival) AS before FROM h),
c AS (SELECT *, CASE WHEN before IS NULL THEN 'created' WHEN before = content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM l),
ch AS (SELECT *, CAST(sum(CASE WHEN action <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, collection, source_uri ORDER BY arrival) AS BIGINT) AS version FROM c)"""


@query(
    "d5_document_changes",
    with_views(["v_docs"], _CHANGES + " SELECT doc_id, content_hash, action, version FROM ch"),
)
def changes(spark, sf_dir):
    return documents.document_changes(view(spark, sf_dir, "v_docs")).select("doc_id", "content_hash", "action", "version")


@query(
    "d5_anonymous_documents",
    with_views(
        ["v_docs"],
        """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY tenant_id, collection, sha256(content) ORDER BY arrival) = 1
  THEN 'created' ELSE 'unchanged' END AS action, CAST(1 AS BIGINT) AS version FROM v_docs""",
    ),
)
def anonymous_changes(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs").withColumn("source_uri", F.lit(None).cast("string"))
    return documents.document_changes(docs).select("doc_id", "action", "version")


@query(
    "d5_document_table",
    with_views(
        ["v_docs"],
        _CHANGES
        + """ SELECT tenant_id, collection, source_uri, arg_max(content_hash, arrival) AS content_hash, max(version) AS version, 'pending' AS status
FROM ch WHERE action <> 'unchanged' GROUP BY 1, 2, 3""",
    ),
)
def document_table(spark, sf_dir):
    changes = documents.document_changes(view(spark, sf_dir, "v_docs"))
    nothing = changes.limit(0).select(
        "tenant_id", "collection", "source_uri", "content", "content_hash", "version", F.lit("ready").alias("status")
    )
    return documents.apply_changes(nothing, changes).drop("content")


@query(
    "j16_unseen_documents",
    with_views(
        ["v_docs"],
        """SELECT doc_id FROM v_docs d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN v_docs k ON k.doc_id = l.doc_id
  WHERE k.tenant_id = d.tenant_id AND k.collection = d.collection AND sha256(k.content) = sha256(d.content))""",
    ),
)
def unseen_documents(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs").withColumn("content_hash", X.content_hash(F.col("content")))
    keys = ["tenant_id", "collection", "content_hash"]
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(*keys)
    return docs.join(known, keys, "left_anti").select("doc_id")


@query(
    "s5_accepted_documents",
    with_views(
        ["v_docs"],
        """SELECT doc_id, source_uri AS title, strlen(content) AS bytes FROM v_docs WHERE strlen(content) <= 10485760 AND trim(content) <> ''""",
    ),
)
def accepted_documents(spark, sf_dir):
    ok, _ = accept_documents(view(spark, sf_dir, "v_docs"))
    return ok.select("doc_id", "title", F.octet_length("content").cast("bigint").alias("bytes"))


@query(
    "p15_collection_names",
    """SELECT page_id, regexp_extract(url, 'http://([^/]*)', 1) AS raw,
  CASE WHEN regexp_matches(lower(trim(regexp_extract(url, 'http://([^/]*)', 1))), '^[a-z0-9][a-z0-9_-]{0,63}$')
    THEN lower(trim(regexp_extract(url, 'http://([^/]*)', 1))) END AS collection,
  regexp_matches(lower(split_part(url, '/', 4)), '^[a-z0-9][a-z0-9_-]{0,63}$') AS path_is_valid FROM pages""",
)
def collection_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("raw", F.regexp_extract("url", "http://([^/]*)", 1))
    return pages.select(
        "page_id", "raw", X.valid_collection(F.col("raw")).alias("collection"),
        X.valid_collection(F.split_part("url", F.lit("/"), F.lit(4))).isNotNull().alias("path_is_valid"),
    )


@query(
    "d1_markdown_sections",
    """WITH t AS (SELECT conv_id, turn, concat(role, ' ', CAST(turn AS VARCHAR)) AS own, trim(text, chr(10) || chr(9) || ' ') AS content FROM conversations),
u AS (SELECT *, last_value(CASE WHEN turn % 3 = 0 THEN own END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM t)
SELECT conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS section_index,
  concat('Conversation ', CAST(conv_id AS VARCHAR), CASE WHEN parent IS NULL THEN '' ELSE concat(' > ', parent) END,
    CASE WHEN turn % 3 = 0 THEN '' ELSE concat(' > ', own) END) AS heading, content FROM u WHERE content <> ''""",
)
def markdown_sections(spark, sf_dir):
    return documents.markdown_sections(view(spark, sf_dir, "v_markdown"))


@query("d2_document_chunks")
def document_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return documents.chunk_documents(docs)


@query("d3_markdown_chunks")
def markdown_chunks(spark, sf_dir):
    return documents.chunk_documents(view(spark, sf_dir, "v_markdown"))


# chunks with a vector only where the corpus has one: documents past it fail or stay pending
_PROCESSED = """proc AS (SELECT d.doc_id AS document_id, e.embedding FROM v_docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  WHERE d.collection <> (SELECT max(collection) FROM v_docs))"""


def _processed(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs")
    last = docs.agg(F.max("collection")).first()[0]
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (
        docs.where(F.col("collection") != F.lit(last))
        .join(vectors, "doc_id", "left")
        .select(F.col("doc_id").alias("document_id"), "embedding")
    )


@query(
    "a22_document_status",
    with_views(
        ["v_docs"],
        _PROCESSED
        + """, n AS (SELECT document_id, count(*) AS chunk_count, count(embedding) AS embedded FROM proc GROUP BY 1)
SELECT doc_id AS document_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(embedded, 0) AS embedded,
  CASE WHEN n.document_id IS NULL THEN 'pending' WHEN embedded = 0 THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN embedded = 0 THEN 'no chunks could be embedded' END AS error
FROM v_docs d LEFT JOIN n ON n.document_id = d.doc_id""",
    ),
)
def document_status(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs").select(F.col("doc_id").alias("document_id"))
    out = documents.document_status(docs, _processed(spark, sf_dir))
    return out.select("document_id", "chunk_count", "embedded", "status", "error")


@query(
    "d6_install_chunks",
    with_views(
        ["v_docs"],
        """fresh AS (SELECT d.doc_id AS document_id, CAST(1 + d.doc_id % 3 AS BIGINT) AS version, e.embedding IS NOT NULL AS has
  FROM v_docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
good AS (SELECT document_id FROM fresh WHERE version >= 2 AND has)
SELECT doc_id AS document_id, CAST(0 AS BIGINT) AS chunk_index, 'old' AS content FROM v_docs WHERE doc_id NOT IN (SELECT document_id FROM good)
UNION ALL SELECT document_id, CAST(0 AS BIGINT), 'new' FROM good""",
    ),
)
def install_chunks(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    zero = F.lit(0).cast("bigint").alias("chunk_index")
    live = docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), zero, F.lit("old").alias("content"), "embedding"
    )
    fresh = live.withColumn("content", F.lit("new")).withColumn("version", 1 + F.col("document_id") % 3)
    versions = live.select("document_id", F.lit(2).cast("bigint").alias("version"))
    return documents.install_chunks(live, fresh, versions).drop("embedding")


@query(
    "j20_cascade_delete",
    with_views(
        ["v_docs"],
        """gone AS (SELECT d.doc_id FROM v_docs d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 OR (l.quality = 0 AND d.tenant_id = 'en'))
SELECT 'document' AS kind, doc_id AS document_id FROM v_docs WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunk', vec_id FROM embeddings JOIN v_docs ON doc_id = vec_id WHERE vec_id NOT IN (SELECT doc_id FROM gone)""",
    ),
)
def cascade_delete(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs").withColumnRenamed("doc_id", "document_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    chunks = vectors.join(docs.select("document_id"), "document_id", "left_semi")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    own = docs.join(labels, "document_id")
    # a key that names the wrong tenant must not delete: low quality is only deletable for 'en'
    keys = own.where("toxic = 1").select("document_id", "tenant_id").unionByName(
        own.where("quality = 0").select("document_id", F.lit("en").alias("tenant_id"))
    )
    left_docs, left_chunks = documents.delete_documents(docs, chunks, keys)
    return left_docs.select(F.lit("document").alias("kind"), "document_id").unionByName(
        left_chunks.select(F.lit("chunk").alias("kind"), "document_id")
    )


@query(
    "s12_document_listing",
    with_views(
        ["v_docs"],
        """SELECT tenant_id, collection, doc_id AS document_id, position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, collection
  ORDER BY arrival DESC, doc_id DESC) AS position FROM v_docs) WHERE position <= 100""",
    ),
)
def document_listing(spark, sf_dir):
    docs = view(spark, sf_dir, "v_docs").select(
        F.col("doc_id").alias("document_id"), "tenant_id", "collection", F.col("arrival").alias("created_at")
    )
    return documents.list_documents(docs).select("tenant_id", "collection", "document_id", "position")


@query(
    "t11_stale_versions",
    with_views(
        ["v_docs"],
        _CHANGES
        + """, m AS (SELECT *, max(version) OVER (PARTITION BY tenant_id, collection, source_uri) AS newest FROM ch)
SELECT doc_id, version < newest AS superseded FROM m WHERE action <> 'unchanged'""",
    ),
)
def stale_versions(spark, sf_dir):
    changed = documents.document_changes(view(spark, sf_dir, "v_docs")).where("action <> 'unchanged'")
    path = ["tenant_id", "collection", "source_uri"]
    newest = changed.groupBy(*path).agg(F.max("version").alias("newest"))
    return changed.join(newest, path).select("doc_id", (F.col("version") < F.col("newest")).alias("superseded"))


# --- retrieval ---

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _duck_tokens(expr: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({expr}), '[^a-z0-9_.-]+'), "
        f"lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
    )


_ARMS = f"""sem0 AS (SELECT q.query_id, c.chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS similarity
  FROM v_questions q JOIN v_chunks c ON c.tenant_id = q.tenant_id AND c.collection = q.collection),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sem0 WHERE similarity IS NOT NULL) WHERE rank <= 20),
terms AS (SELECT query_id, tenant_id, collection, unnest(list_distinct({_duck_tokens('query_text')})) AS term FROM v_questions),
kw0 AS (SELECT t.query_id, c.chunk_id, count(*) AS hits FROM terms t JOIN v_chunks c ON c.tenant_id = t.tenant_id AND c.collection = t.collection
  AND c.content ILIKE concat('%', t.term, '%') GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM kw0) WHERE rank <= 20)"""

_FUSED = (
    _ARMS
    + """, lists AS (SELECT query_id, chunk_id, rank, 0 AS list_no FROM sem UNION ALL SELECT query_id, chunk_id, rank, 1 FROM kw),
rrf0 AS (SELECT query_id, chunk_id, sum(1.0 / (59 + rank)) AS rrf, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM rrf0) WHERE rank <= 20)"""
)


def _mmr(candidates: str) -> str:
    """Five greedy picks as five chained steps over (query_id, chunk_id, rank, similarity) in `candidates`."""
    steps = [
        f"""cand AS (SELECT c.query_id, c.chunk_id, c.rank, c.similarity, list_distinct({_duck_tokens('k.content')}) AS toks,
  list_distinct({_duck_tokens('q.query_text')}) AS qt FROM {candidates} c JOIN v_chunks k ON k.chunk_id = c.chunk_id JOIN v_questions q ON q.query_id = c.query_id),
sc AS (SELECT *, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, toks)) / len(qt) ELSE 0 END AS lexical FROM cand),
pool AS (SELECT *, 0.7::DOUBLE * similarity + (1 - 0.7::DOUBLE) * lexical AS score FROM sc),
pick0 AS (SELECT query_id, NULL::BIGINT AS chunk_id, 0 AS pos, 0.0 AS value FROM pool WHERE false)"""
    ]
    for n in range(1, 6):
        chosen = " UNION ALL ".join(f"SELECT query_id, chunk_id, pos, value FROM pick{i}" for i in range(n))
        steps.append(
            f"""done{n} AS ({chosen}),
cost{n} AS (SELECT p.query_id, p.chunk_id, p.rank, p.score, coalesce(max(CASE WHEN len(p.toks) > 0 AND len(o.toks) > 0
    THEN len(list_intersect(o.toks, p.toks)) / sqrt(len(o.toks) * len(p.toks)) ELSE 0 END), 0) AS worst
  FROM pool p LEFT JOIN done{n} d ON d.query_id = p.query_id LEFT JOIN pool o ON o.query_id = d.query_id AND o.chunk_id = d.chunk_id
  WHERE (p.query_id, p.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM done{n}) GROUP BY 1, 2, 3, 4),
val{n} AS (SELECT query_id, chunk_id, 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * worst AS value, rank FROM cost{n}),
pick{n} AS (SELECT query_id, chunk_id, {n} AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 12) DESC, rank) AS rn FROM val{n}) WHERE rn = 1)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, 6))
    steps.append(f"picks AS ({union})")
    return ",\n".join(steps)


_MMR_OUT = """ SELECT k.query_id, k.chunk_id, CAST(k.pos AS BIGINT) AS position, round(p.similarity, 6) AS similarity, round(p.lexical, 6) AS lexical,
  round(p.score, 6) AS score, round(k.value, 6) AS rerank_score FROM picks k JOIN pool p ON p.query_id = k.query_id AND p.chunk_id = k.chunk_id"""


def _corpus(spark, sf_dir):
    heading = F.lit(None).cast("string").alias("heading")
    return view(spark, sf_dir, "v_questions"), view(spark, sf_dir, "v_chunks").select("*", heading)


@query("v1_semantic_search", with_views(["v_questions", "v_chunks"], _ARMS + " SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM sem"))
def semantic(spark, sf_dir):
    return rounded(retrieval.semantic_search(*_corpus(spark, sf_dir)), "similarity")


@query("v1_approximate")
def approximate(spark, sf_dir):
    """Every hundredth vector asks, all chunks of its tenant are searched."""
    chunks = view(spark, sf_dir, "v_chunks").where("embedding IS NOT NULL")
    asked = chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    quantiser = vector_index.fit_quantiser(chunks)
    index = vector_index.index_chunks(chunks, quantiser)
    return rounded(vector_index.probe(asked, index, quantiser), "similarity")


@query("v2_keyword_search", with_views(["v_questions", "v_chunks"], _ARMS + " SELECT query_id, chunk_id, hits, rank FROM kw"))
def keyword(spark, sf_dir):
    return retrieval.keyword_search(*_corpus(spark, sf_dir))


@query(
    "v3_reciprocal_rank_fusion",
    with_views(["v_questions", "v_chunks"], _FUSED + " SELECT query_id, chunk_id, round(rrf, 6) AS rrf, rank FROM fused"),
)
def fusion(spark, sf_dir):
    fused = retrieval.hybrid_candidates(*_corpus(spark, sf_dir))
    return rounded(fused.select("query_id", "chunk_id", "rrf", "rank"), "rrf")


@query("v5_retrieve", with_views(["v_questions", "v_chunks"], _ARMS + ",\n" + _mmr("sem") + _MMR_OUT))
def retrieve(spark, sf_dir):
    return rounded(retrieval.retrieve(*_corpus(spark, sf_dir)), "similarity", "lexical", "score", "rerank_score")


_HYBRID = _FUSED + """, hyb AS (SELECT f.query_id, f.chunk_id, f.rank, coalesce(s.similarity, 0) AS similarity
  FROM fused f LEFT JOIN sem s ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id),
"""


@query("v6_retrieve_hybrid", with_views(["v_questions", "v_chunks"], _HYBRID + _mmr("hyb") + _MMR_OUT))
def retrieve_hybrid(spark, sf_dir):
    return rounded(
        retrieval.retrieve_hybrid(*_corpus(spark, sf_dir)), "similarity", "lexical", "score", "rerank_score"
    )


@query(
    "v7_cited_context",
    with_views(
        ["v_questions", "v_chunks"],
        _HYBRID
        + _mmr("hyb")
        + """, hits AS (SELECT k.query_id, k.chunk_id, k.pos, p.score FROM picks k JOIN pool p ON p.query_id = k.query_id AND p.chunk_id = k.chunk_id WHERE p.score >= 0.15),
n AS (SELECT h.*, c.title, c.content, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS ref FROM hits h JOIN v_chunks c ON c.chunk_id = h.chunk_id),
b AS (SELECT *, concat('[[', CAST(ref AS VARCHAR), ']] ', title, chr(10), content) AS block FROM n),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY ref) AS used FROM b)
SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ref) AS context, count(*) AS sources FROM u WHERE ref = 1 OR used <= 6000 GROUP BY 1""",
    ),
)
def cited_context(spark, sf_dir):
    questions, chunks = _corpus(spark, sf_dir)
    hits = retrieval.retrieve_hybrid(questions, chunks)
    return retrieval.pack_context(retrieval.cited_blocks(hits, chunks, min_score=0.15))


@query(
    "v9_similar_incidents",
    with_views(
        ["v_chunks"],
        """k AS (SELECT tenant_id, chunk_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS embedding FROM v_chunks),
s AS (SELECT a.chunk_id AS incident_id, b.chunk_id AS similar_incident_id, list_cosine_similarity(a.embedding, b.embedding) AS similarity
  FROM k a JOIN k b ON a.tenant_id = b.tenant_id AND a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY similarity DESC, similar_incident_id) AS rank FROM s WHERE similarity IS NOT NULL)
SELECT incident_id, similar_incident_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3 AND similarity >= 0.7""",
    ),
)
def similar_incidents(spark, sf_dir):
    # vectors of one orthant lie close enough to pass the floor, some of them
    memory = view(spark, sf_dir, "v_chunks").select(
        "tenant_id", F.col("chunk_id").alias("incident_id"), F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("embedding")
    )
    return rounded(retrieval.similar_incidents(memory, memory), "similarity")


@query(
    "m2_latest_embeddings",
    "SELECT label AS incident_id, max(vec_id) AS report_id FROM embeddings GROUP BY label",
)
def latest_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("incident_id"), F.col("vec_id").alias("report_id"), F.col("vec_id").alias("created_at"), "embedding"
    )
    return retrieval.latest_embeddings(rows).select("incident_id", "report_id")


@query(
    "f21_text_scalars",
    f"""WITH t AS (SELECT doc_id, text, {_duck_tokens('text')} AS toks, {_duck_tokens('lang || chr(32) || source')} AS q FROM documents)
SELECT doc_id, CAST(len(toks) AS INT) AS n_tokens, CAST(len(list_distinct(toks)) AS INT) AS n_terms, sha256(text) AS content_hash, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate,
  round(len(list_intersect(list_distinct(q), toks)) / len(list_distinct(q)), 6) AS lexical FROM t""",
)
def text_scalars(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toks = X.tokens(F.col("text"))
    about = X.tokens(F.concat_ws(" ", "lang", "source"))
    return rounded(
        docs.select(
            "doc_id", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_terms"),
            X.content_hash(F.col("text")).alias("content_hash"), X.token_estimate(F.col("text")).alias("token_estimate"),
            X.lexical_overlap(about, toks).alias("lexical"),
        ),
        "lexical",
    )


@query(
    "f24_vector_scalars",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
  len(a.embedding) = 64 AS has_dims FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rounded(
        e.join(after, "vec_id").select(
            "vec_id",
            V.cosine(F.col("embedding"), F.col("next")).alias("similarity"),
            V.checked_dims(F.col("embedding"), 64).isNotNull().alias("has_dims"),
        ),
        "similarity",
    )
