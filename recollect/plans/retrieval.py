"""Search queries over memories and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import content_words, expanded, query_words, tokens
from recollect.operators import search
from recollect.operators.tables import newest
from recollect.sources.tables import table

ASK = "Where is the red folder on the kitchen counter?"
WORDS = ["red", "folder", "kitchen", "counter", "red"]
CONCEPTS = {"key": ["keys", "lock", "door"], "lost": ["missing", "gone", "search"], "phone": ["call", "charger"], "tea": ["mug", "kettle"], "lab": ["bench", "coat"]}


def memories(spark: SparkSession, d: str) -> DataFrame:
    """One row per id, with the vector read."""
    rows = newest(table(spark, d, "memories"), ["id"], "loaded_at")
    v = F.from_json("embedding", "array<double>")
    fine = F.when((F.size(v) == 96) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), v)
    return rows.select("id", "text", fine.alias("v"), "saved_at")


def first_vector(docs: DataFrame) -> DataFrame:
    """The query vector: that of the smallest id that has one."""
    return docs.where(F.col("v").isNotNull()).orderBy("id").limit(1).select(F.col("v").alias("q"))


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def r1_dense_topk(spark, d):
    m = memories(spark, d)
    return _r6(search.best(search.dense(m, first_vector(m)), "score", 20), "score")


def r2_dense_newest_first(spark, d):
    """Ties by the newest instead of the smallest id; other sizes score 0."""
    m = memories(spark, d)
    scored = search.dense(m, first_vector(m), strict=False).join(m.select("id", "saved_at"), "id")
    return _r6(search.best(scored, F.round("score", 6), 20, F.desc("saved_at")), "score").select("id", "score", "rank")


def r3_bm25_topk(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _r6(search.best(search.bm25(docs, WORDS), F.round("score", 9), 20), "score")


def r6_bm25_plus_topk(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    words = lambda c: content_words(c, ["the", "a", "is", "on", "of", "in"])
    return _r6(search.best(search.bm25(docs, WORDS, True, words), F.round("score", 9), 20), "score")


def r4_prefix_docid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.prefix_hits(docs, ["kitch", "umbr"], 20)


def r5_expanded(spark, d):
    """What expansion adds to every short document read as a query."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    e = expanded(F.col("text"), CONCEPTS)
    added = F.substring(e, F.length("text") + 2, F.length(e))
    return docs.select("doc_id", added.alias("added")).where("added <> ''")


def _lists(spark, d, pool=20):
    m = memories(spark, d)
    return m, search.best(search.dense(m, first_vector(m)), F.round("score", 9), pool), search.best(search.bm25(m, WORDS), F.round("score", 9), pool)


def r7_hybrid_common_first(spark, d):
    _, dense, sparse = _lists(spark, d)
    return _r6(search.fuse_common_first(dense, sparse).select("id", "score", "common", "rank"), "score")


def r8_hybrid_rrf_sum(spark, d):
    _, dense, sparse = _lists(spark, d)
    return _r6(search.fuse_sum([dense, sparse]), "score")


def r9_rrf_eval(spark, d):
    _, dense, sparse = _lists(spark, d)
    return _r6(search.fuse_sum([sparse, dense], 60), "score")


def r10_attributed(spark, d):
    m = memories(spark, d)
    h = search.hybrid(m, first_vector(m), WORDS)
    badge = F.when((F.col("match") == "both") | ((F.col("semantic") > 0.3) & (F.col("keyword") > 0)), "both").when(F.col("match") == "bm25", "bm25").otherwise("semantic")
    return _r6(h.select("id", "rank", "match", "score", "semantic", "keyword", badge.alias("badge")), "score", "semantic", "keyword")


def r12_reranked(spark, d):
    m = memories(spark, d)
    h = search.hybrid(m, first_vector(m), WORDS, rerank=search.lexical_rerank, text=ASK)
    return _r6(h.select("id", "rank", "match", "score"), "score")


def r13_overlap_rescored(spark, d):
    m, dense, sparse = _lists(spark, d)
    few = search.fuse_sum([dense, sparse]).where("rank < 20").join(m.select("id", "text"), "id")
    return _r6(few.select("id", "rank", search.overlap_score(F.col("rank"), F.coalesce("text", F.lit("")), ASK).alias("score")), "score")


def r14_overlap_fallback(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.overlap_fallback(docs, "Zokari umbrella balcony", 20)


def r14_nothing_shared(spark, d):
    """The same where no document shares a word: the first ones by id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.overlap_fallback(docs, "qqxvz wwkpf", 20)


def r15_knn_batch(spark, d):
    """Every text vector whose id is divisible by 100 against all of them."""
    v = newest(table(spark, d, "text_vec"), ["text_id"], "loaded_at").select(F.col("text_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = v.where((F.size("v") == 96) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0.0))
    return search.block_search(ok, ok.where("id % 100 = 0"), 96, 5)


def r16_all_scores(spark, d):
    """The likeness of every usable image vector to the first one."""
    v = newest(table(spark, d, "image_vec"), ["frame_id"], "loaded_at").select(F.col("frame_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where((F.size("v") == 128) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    return _r6(search.dense(v, first_vector(v)), "score")


def r24_prompt(spark, d):
    m, dense, sparse = _lists(spark, d)
    return search.context(search.fuse_common_first(dense, sparse).where("rank < 5"), m)


def f2_token_counts(spark, d):
    """Tokens and different tokens of every document."""
    docs = table(spark, d, "documents")
    t = tokens(F.col("text"))
    return docs.where("text is not null").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_kinds"))


QUERIES = {f.__name__: f for f in (
    r1_dense_topk, r2_dense_newest_first, r3_bm25_topk, r4_prefix_docid, r5_expanded, r6_bm25_plus_topk, r7_hybrid_common_first, r8_hybrid_rrf_sum,
    r9_rrf_eval, r10_attributed, r12_reranked, r13_overlap_rescored, r14_overlap_fallback, r14_nothing_shared, r15_knn_batch, r16_all_scores, r24_prompt, f2_token_counts)}

_M = """
m AS (SELECT id, text, saved_at, CASE WHEN len(v) = 96 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 THEN v END v FROM (
  SELECT id, text, saved_at, TRY_CAST(embedding AS DOUBLE[]) v FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)),
q AS (SELECT v q FROM m WHERE v IS NOT NULL ORDER BY id LIMIT 1),
ds AS (SELECT id, saved_at, list_dot_product(v, q) score FROM m, q WHERE v IS NOT NULL),
dl AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 rank, score FROM ds QUALIFY rank < 20)
"""


def _bm25(source: str, pattern: str, plus_one: bool, drop: str = "") -> str:
    idf = "ln(1 + x)" if plus_one else "CASE WHEN x > 1 THEN ln(x) ELSE 1e-6 END"
    keep = f"list_filter(regexp_extract_all(lower(text), '{pattern}'), lambda w: w NOT IN ({drop}))" if drop else f"regexp_extract_all(lower(text), '{pattern}')"
    return f"""
kt AS (SELECT id, {keep} t FROM {source} WHERE text IS NOT NULL),
kq AS (SELECT unnest({WORDS!r}) w),
kn AS (SELECT count(*) n, avg(len(t)) a FROM kt),
kf AS (SELECT id, len(t) dl, w, len(list_filter(t, lambda z: z = w)) tf FROM kt, kq),
kd AS (SELECT w, (n - df + 0.5) / (df + 0.5) x FROM (SELECT w, count(DISTINCT id) df FROM kf WHERE tf > 0 GROUP BY w), kn),
ks AS (SELECT id, sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) score FROM kf JOIN kd USING (w), kn WHERE tf > 0 GROUP BY id),
kl AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 rank, score FROM ks QUALIFY rank < 20)
"""


_K = _bm25("m", r"[\p{L}\p{N}]+", False)
_DOC = "doc AS (SELECT doc_id id, text FROM documents)"
_CF = """
fc AS (SELECT coalesce(d.id, s.id) id, coalesce(1.0 / (61 + d.rank), 0) + coalesce(1.0 / (61 + s.rank), 0) score, d.rank rd, s.rank rs FROM dl d FULL JOIN kl s ON d.id = s.id),
f AS (SELECT *, CASE WHEN rd IS NOT NULL AND rs IS NOT NULL THEN 1 ELSE 0 END common,
  row_number() OVER (ORDER BY CASE WHEN rd IS NOT NULL AND rs IS NOT NULL THEN 1 ELSE 0 END DESC, score DESC, CASE WHEN rd IS NOT NULL THEN 0 ELSE 1 END, coalesce(rd, rs), id) - 1 rank FROM fc)
"""


def _sum(first: str, second: str, offset: int) -> str:
    return f"""
fu AS (SELECT id, rank, 0 l FROM {first} UNION ALL SELECT id, rank, 1 FROM {second}),
fs AS (SELECT id, sum(1.0 / ({offset} + rank)) score, min(l * 1000 + rank) o FROM fu GROUP BY id),
f AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 12) DESC, o, id) - 1 rank FROM fs)
"""


_ASK = sorted({"where", "the", "red", "folder", "kitchen", "counter"})
_V = "list_filter(v, lambda x: x IS NULL OR isnan(x))"

SQL = {
    "r1_dense_topk": f"WITH {_M} SELECT id, round(score, 6) score, row_number() OVER (ORDER BY score DESC, id) - 1 rank FROM ds QUALIFY rank < 20",
    "r2_dense_newest_first": f"WITH {_M} SELECT id, round(score, 6) score, row_number() OVER (ORDER BY round(score, 6) DESC, saved_at DESC, id) - 1 rank FROM ds QUALIFY rank < 20",
    "r3_bm25_topk": f"WITH {_DOC}, {_bm25('doc', '[\\p{L}\\p{N}]+', False)} SELECT id, round(score, 6) score, rank FROM kl",
    "r6_bm25_plus_topk": f"WITH {_DOC}, {_bm25('doc', '[a-z]+', True, "'the', 'a', 'is', 'on', 'of', 'in'")} SELECT id, round(score, 6) score, rank FROM kl",
    "r4_prefix_docid": r"""SELECT doc_id id, row_number() OVER (ORDER BY doc_id) - 1 rank FROM documents
WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: starts_with(t, 'kitch') OR starts_with(t, 'umbr'))) > 0 QUALIFY rank < 20""",
    "r5_expanded": "SELECT doc_id, added FROM (SELECT doc_id, concat_ws(' ', " + ", ".join(f"CASE WHEN contains(lower(text), '{c}') THEN '{' '.join(w)}' END" for c, w in CONCEPTS.items()) + ") added FROM documents WHERE text IS NOT NULL) WHERE added <> ''",
    "r7_hybrid_common_first": f"WITH {_M}, {_K}, {_CF} SELECT id, round(score, 6) score, common, rank FROM f",
    "r8_hybrid_rrf_sum": f"WITH {_M}, {_K}, {_sum('dl', 'kl', 61)} SELECT id, round(score, 6) score, rank FROM f",
    "r9_rrf_eval": f"WITH {_M}, {_K}, {_sum('kl', 'dl', 60)} SELECT id, round(score, 6) score, rank FROM f",
    "r10_attributed": f"""WITH {_M}, {_K}, {_CF}, h AS (SELECT f.id, f.rank, CASE WHEN common = 1 THEN 'both' WHEN rd IS NOT NULL THEN 'semantic' ELSE 'bm25' END match, f.score, ds.score semantic, ks.score keyword
FROM f LEFT JOIN ds ON f.id = ds.id LEFT JOIN ks ON f.id = ks.id WHERE f.rank < 5)
SELECT id, rank, match, round(score, 6) score, round(semantic, 6) semantic, round(keyword, 6) keyword,
CASE WHEN match = 'both' OR (semantic > 0.3 AND keyword > 0) THEN 'both' WHEN match = 'bm25' THEN 'bm25' ELSE 'semantic' END badge FROM h""",
    "r12_reranked": f"""WITH {_M}, {_K}, {_CF}, c AS (SELECT f.id, len(list_intersect({sorted(set(query_words(ASK)))!r}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'))) / {len(set(query_words(ASK)))}.0 s FROM f JOIN m USING (id) WHERE f.rank < 20)
SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 rank, 'reranked' match, round(s, 6)::DOUBLE score FROM c QUALIFY rank < 5""",
    "r13_overlap_rescored": f"""WITH {_M}, {_K}, {_sum('dl', 'kl', 61)} SELECT f.id, f.rank, round(greatest(0.1, least(0.98, 0.55 / (1 + f.rank * 0.15)
+ 0.45 * len(list_intersect({_ASK!r}, regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9]+'))) / {len(_ASK)}.0)), 6) score FROM f JOIN m USING (id) WHERE f.rank < 20""",
    "r14_overlap_fallback": """SELECT * FROM (SELECT id, overlap, row_number() OVER (ORDER BY overlap DESC, id) - 1 rank FROM (
SELECT doc_id id, len(list_intersect(['zokari', 'umbrella', 'balcony'], regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'))) overlap FROM documents) WHERE overlap > 0) WHERE rank < 20""",
    "r14_nothing_shared": "SELECT doc_id id, CAST(0 AS BIGINT) overlap, row_number() OVER (ORDER BY doc_id) - 1 rank FROM documents QUALIFY rank < 20",
    "r15_knn_batch": f"""WITH t AS (SELECT text_id id, CAST(embedding AS DOUBLE[]) v FROM text_vec QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY loaded_at DESC) = 1),
u AS (SELECT * FROM t WHERE len(v) = 96 AND len({_V}) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
SELECT a.id query, b.id, round(list_cosine_similarity(a.v, b.v), 6) score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) place
FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0 QUALIFY place <= 5""",
    "r16_all_scores": f"""WITH t AS (SELECT frame_id id, CAST(embedding AS DOUBLE[]) v FROM image_vec QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY loaded_at DESC) = 1),
u AS (SELECT * FROM t WHERE len(v) = 128 AND len({_V}) = 0), q AS (SELECT v q FROM u ORDER BY id LIMIT 1)
SELECT id, round(list_dot_product(v, q), 6) score FROM u, q""",
    "r24_prompt": f"WITH {_M}, {_K}, {_CF} SELECT string_agg('[' || (rank + 1) || '] ' || text, chr(10) ORDER BY rank) prompt FROM f JOIN m USING (id) WHERE rank < 5",
    "f2_token_counts": r"""SELECT doc_id, len(t) n_tokens, len(list_distinct(t)) n_kinds FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t FROM documents WHERE text IS NOT NULL)""",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of the memories, five rows."""
    m = memories(spark, d)
    h = search.hybrid(m, first_vector(m), query_words(ASK), rerank=search.lexical_rerank, text=ASK)
    return h.join(m.select("id", "text"), "id").orderBy("rank")
