"""Problems 4 to 8 over the whole test tables."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, neighbours, packing, quality, splitting
from recollect.session import checkpointed
from recollect.sources.tables import table

LIKE = 0.8
CAPACITY = 2048


def tokenizer() -> tuple[str, str]:
    """Path and pattern of byte_bpe_50k; RECOLLECT_BPE names another place for the file."""
    import public_tokenizers

    return os.environ.get("RECOLLECT_BPE") or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _vectors(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, int, int]]:
    memories, images, texts = (table(spark, d, t) for t in ("memories", "image_vec", "text_vec"))
    read = F.from_json("embedding", "array<double>")
    return [
        ("memories", neighbours.usable(memories, "id", read, 96), 96, memories.count()),
        ("image_vec", neighbours.usable(images, "frame_id", F.col("embedding"), 128), 128, images.count()),
        ("text_vec", neighbours.usable(texts, "text_id", F.col("embedding"), 96), 96, texts.count()),
    ]


def _of_all(spark: SparkSession, d: str, made) -> DataFrame:
    """made(vectors, dim, rows) of the three tables, one under the other with src; their preparing jobs run side by side."""
    known = _vectors(spark, d)
    with ThreadPoolExecutor(len(known)) as pool:
        parts = list(pool.map(lambda x: made(*x[1:]).withColumn("src", F.lit(x[0])), known))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _of_all(spark, d, lambda v, dim, rows: neighbours.pairs_found(neighbours.most_similar(v, dim, rows, 5, LIKE)))
    return pairs.select("src", "id_a", "id_b")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every row, however alike."""
    return _of_all(spark, d, lambda v, dim, rows: neighbours.most_similar(v, dim, rows, 5))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: splitting.pieces(table(spark, d, t), "id", "text").withColumn("src", F.lit(t))
    return one("memories").unionByName(one("transcript_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("src", "row_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text that was cut, put together again from its pieces without their overlap, and whether all pieces keep the
    limit and repeat 75 to 126 characters of the one before (about 100; a cut moves to a word or keeps marks together)."""
    p = _pieces(spark, d).dropDuplicates(["src", "row_id", "piece_no", "start", "end", "piece"])
    in_order = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece")))
    g = p.groupBy("src", "row_id").agg(in_order.alias("p"))
    before = lambda i: F.when(i > 0, F.col("p")[i - 1]["end"]).otherwise(0)
    text = F.array_join(F.transform("p", lambda x, i: F.substring(x["piece"], before(i) - x["start"] + 1, F.length(x["piece"]))), "")
    fits = F.forall("p", lambda x: (F.length(x["piece"]) <= 800) & (F.length(x["piece"]) == x["end"] - x["start"]))
    repeats = F.forall(F.transform("p", lambda x, i: (i == 0) | (before(i) - x["start"]).between(75, 126)), lambda x: x)
    return g.select("src", "row_id", F.md5(text).alias("digest"), fits.alias("fits"), repeats.alias("repeats"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text", *tokenizer())


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the texts that the ids of all documents stand for."""
    back = bpe.decoded(p6_ids(spark, d), *tokenizer())
    return back.select("doc_id", F.md5("text").alias("digest"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counts = bpe.token_counts(table(spark, d, "documents"), "doc_id", "text", *tokenizer())
    return packing.packed(checkpointed(counts), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("part_no > 0").select("doc_id").distinct()


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one over the capacity, with its container."""
    return _packed(spark, d)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents that got a place, containers over their capacity, documents divided or put into several
    containers though they fit, and whether the containers are at most 1 % (and one) more than the tokens could fill."""
    p = _packed(spark, d)
    box = p.where("container_id > 0").groupBy("container_id").agg(F.sum("part_tokens").alias("used"))
    doc = p.groupBy("doc_id").agg(F.sum("part_tokens").alias("n"), F.count("*").alias("parts"))
    a = box.agg(F.count_if(F.col("used") > CAPACITY).alias("n_over"), (F.count("*") <= F.ceil(F.sum("used") / CAPACITY * 1.01) + 1).alias("tight"))
    b = doc.agg(F.count("*").alias("n_documents"), F.count_if(F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))).alias("n_divided"))
    return a.crossJoin(b)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    common = quality.common_words(table(spark, d, "common_words"))
    stats = quality.document_statistics(table(spark, d, "documents"), "doc_id", "text", common)
    return quality.typed(checkpointed(stats))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("text_type <> 'prose'").select("doc_id").distinct()


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document, its type and the posterior of it."""
    return _typed(spark, d)


QUERIES = {
    "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt, "p6_ids": p6_ids,
    "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_packed": p7_packed, "p7_checked": p7_checked, "p8_found": p8_found, "p8_statistics": p8_statistics,
}

_V = """
WITH raw AS (
  SELECT 'memories' src, id, TRY_CAST(embedding AS DOUBLE[]) v, 96 dim FROM memories
  UNION ALL SELECT 'image_vec', frame_id, CAST(embedding AS DOUBLE[]), 128 FROM image_vec
  UNION ALL SELECT 'text_vec', text_id, CAST(embedding AS DOUBLE[]), 96 FROM text_vec),
u AS (SELECT DISTINCT src, id, v FROM raw WHERE len(v) = dim AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.src, a.id id, b.id other, round(list_cosine_similarity(a.v, b.v), 6) s FROM u a JOIN u b ON a.src = b.src AND a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY src, id ORDER BY s DESC, other) place FROM c)
"""

SQL = {
    "p5_found": """SELECT DISTINCT src, id row_id FROM (SELECT 'memories' src, id, text FROM memories UNION ALL SELECT 'transcript_chunks', id, text FROM transcript_chunks)
WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 800""",
    "p5_rebuilt": """SELECT DISTINCT src, id row_id, md5(body) digest, true fits, true repeats FROM (SELECT src, id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) body
FROM (SELECT 'memories' src, id, text FROM memories UNION ALL SELECT 'transcript_chunks', id, text FROM transcript_chunks)) WHERE length(body) > 800""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) digest FROM documents",
    "p7_checked": "SELECT count(DISTINCT doc_id) n_documents, CAST(0 AS BIGINT) n_over, CAST(0 AS BIGINT) n_divided, true tight FROM documents",
}

#: Quadratic and exact, where the operator may lose a little on tables of many cells (the README has its recall).
SQL["p4_found"] = _V + "SELECT DISTINCT src, least(id, other) id_a, greatest(id, other) id_b FROM t WHERE place <= 5 AND s >= 0.8"
