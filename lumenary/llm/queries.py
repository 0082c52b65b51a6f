"""The training-data operators as queries over the driver's tables, with SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import common
from lumenary.llm.common import vocabulary
from lumenary.llm.pieces import BYTE_PATTERN
from lumenary.session import ship, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, a small one dealt to all cores."""
    ship(spark)
    return spread(common.documents(spark, sf_dir))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.chunks import temporary_chunks
    from lumenary.llm.suffix_dedup import remove_repeats

    with temporary_chunks(spark):
        return common.checkpointed(
            remove_repeats(documents(spark, sf_dir), length=50).select(
                "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
            )
        )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.sharding import shard

    maps = f"{common.scratch(spark)}/shard-maps-{uuid.uuid4().hex}"
    placed, _ = shard(common.documents(spark, sf_dir), n_shards=40, maps=maps)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), BYTE_PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.packing import pack

    ship(spark)  # each split ends with one partly filled window, so splits are not made smaller
    pieces = pack(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), spaced=True, end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.secrets import KINDS, scan

    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The chain over low quality and toxicity, fitted on the labelled documents of ``docs``."""
    from lumenary.llm.toxicity import train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return train(docs, labels, ["low_quality", "toxic"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.toxicity import LEAST, score

    docs = documents(spark, sf_dir)
    scored = score(docs, toxicity_chain(spark, docs, sf_dir))
    return scored.select("doc_id", (F.col("p_toxic") >= LEAST).cast("int").alias("toxic"), "p_toxic", "p_low_quality")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.fingerprint import likeness

    return likeness(documents(spark, sf_dir))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.vector_dedup import near_duplicates

    ship(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenary.llm.token_files import round_trip

    held = round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), spaced=False, end_id=0)
    return held.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_token_files": op10_token_files,
}

#: Components by reachability over links ``l(a, b)`` (both ways) of rows ``r(id)``.
_REACH = """reach AS (SELECT id, id AS other FROM r UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id FROM c JOIN n ON n.doc_id = c.id""",
    "op9_vector_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.s > 0 AND b.s > 0 AND list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.9),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), r AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN k ON k.a = id""",
}
