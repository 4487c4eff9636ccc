"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import line_quality
from firmlens.llm.chat_template import format_conversations, turns_of, unescape
from firmlens.llm.circulant_minhash import near_duplicates
from firmlens.llm.hard_negatives import mine
from firmlens.llm.license_scan import license_scan
from firmlens.llm.main_text import main_text
from firmlens.llm.merkle_manifest import folded, manifest, proof_digest
from firmlens.llm.ngram_join import jaccard_components
from firmlens.llm.packing import pack
from firmlens.llm.passages import repeated_passages
from firmlens.llm.piece_bpe import decode, encode
from firmlens.llm.token_shards import write_shards
from firmlens.llm.vector_search import nearest_neighbours
from firmlens.session import ship, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return query(ship(tune(spark)), sf.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_ngram_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more, as components."""
    return jaccard_components(_table(spark, sf, "documents"), size=4, num=85, den=100)


@_query("op2_token_shards")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as shards of 512-id records in training order; the index of every record."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return write_shards(_table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, end_id=50256)


@_query("op3_main_text")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return main_text(_table(spark, sf, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op4_piece_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(_table(spark, sf, "documents"), model), model)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query("op5_license_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of a license text or notice in every document."""
    return license_scan(_table(spark, sf, "documents"))


@_query("op6_line_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document; the line field is fitted on a bounded sample of ``labels``."""
    docs = _table(spark, sf, "documents")
    judged = line_quality.judge(docs, line_quality.fit(docs, _table(spark, sf, "labels")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_content_lines",
    )


@_query("op7_passages")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document, or an earlier place of the same one, holds too."""
    return repeated_passages(_table(spark, sf, "documents"), min_words=50, identity=0.8)


@_query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth vector, out of all vectors."""
    return nearest_neighbours(_table(spark, sf, "embeddings"), F.expr("id % 100 = 0"), k=10)


_CHAT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of every conversation, from its rendering alone; parts of a conversation come one after the other."""
    rows = []
    parts = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    for conv, own in groupby(parts, key=lambda row: row[0]):
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for _, _, text, starts, ends in own:
            for role, said in turns_of(text):
                turns.update(f"{role}\n{said}\n".encode())
                counts[0] += 1
            for low, high in zip(starts, ends):
                trained = unescape(text[low:high])
                loss.update(trained.encode())
                counts[1] += len(trained)
            counts[2] += len(text)
        rows.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[p.split(" ")[0] for p in _CHAT.split(", ")])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[p.split(" ")[0] for p in _CHAT.split(", ")])


@_query("op9_chat_template")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that says control strings, read back from the output."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return format_conversations(turns.unionByName(probe)).mapInArrow(_read_back, _CHAT)


@_query("op10_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2048 ids, one row per piece."""
    return pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


@_query("op11_circulant_minhash")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose sets of two-word shingles have a Jaccard similarity of 0.8 or more, as groups."""
    return near_duplicates(_table(spark, sf, "documents"), size=2, num=80, den=100)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _merkle_sql(levels: int = 10) -> str:
    """The manifest in SQL, a fixed number of levels of eight children each (8 ** levels rows per language)."""
    parts = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    known = " || ".join(parts)
    steps = [
        """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
            list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))""",
        f"""leaves AS MATERIALIZED (SELECT doc_id, lang, sha256({known} || coalesce(strlen(text)::varchar || ':' || text, '-')) AS leaf,
            coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit,
            sha256({known} || coalesce(strlen(text)::varchar || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-')) AS altered
            FROM documents, crc)""",
        """n0 AS MATERIALIZED (SELECT *, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY lang) AS cnt, CASE WHEN hit THEN altered ELSE leaf END AS f, '' AS proof FROM leaves)""",
    ]

    def level(name: str, before: str, tree: str) -> list[str]:
        group = f"{tree}, pos // 8" if tree else "pos // 8"
        same = f"r.{tree} IS NOT DISTINCT FROM n.{tree} AND " if tree else ""
        head = f"{tree}, " if tree else ""
        return [
            f"""k{name} AS (SELECT {head}pos // 8 AS run, list(DISTINCT {{'p': pos, 'd': node}}) AS kids FROM {before} WHERE cnt > 1 GROUP BY {group})""",
            f"""r{name} AS (SELECT {head}run, list_transform(list_sort(kids), lambda x: x.d) AS ds FROM k{name})""",
            f"""{name} AS MATERIALIZED (SELECT n.* EXCLUDE (node, pos, cnt, f, proof),
                CASE WHEN ds IS NULL THEN node ELSE sha256(array_to_string(ds, '')) END AS node, pos // 8 AS pos, (cnt + 7) // 8 AS cnt,
                CASE WHEN ds IS NULL THEN f ELSE sha256(array_to_string(ds[:pos % 8], '') || f || array_to_string(ds[pos % 8 + 2:], '')) END AS f,
                CASE WHEN ds IS NULL THEN proof ELSE proof || array_to_string(ds[:pos % 8], '') || array_to_string(ds[pos % 8 + 2:], '') END AS proof
                FROM {before} n LEFT JOIN r{name} r ON {same}r.run = n.pos // 8 AND n.cnt > 1)""",
        ]

    for at in range(levels):
        steps += level(f"n{at + 1}", f"n{at}", "lang")
    steps.append(
        f"""m0 AS MATERIALIZED (SELECT * EXCLUDE (pos, cnt), node AS subroot, dense_rank() OVER (ORDER BY coalesce('=' || lang, '-')) - 1 AS pos,
            (SELECT count(DISTINCT coalesce('=' || lang, '-')) FROM leaves) AS cnt FROM n{levels})"""
    )
    for at in range(levels):
        steps += level(f"m{at + 1}", f"m{at}", "")
    return (
        "WITH " + ", ".join(steps) + f" SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, f AS folded_root, "
        f"f = node AS verified FROM m{levels}"
    )


@_query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Digest, proof and verdict of every document; a third of them is tampered with by lower-casing the text."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    found = manifest(_table(spark, sf, "documents"), claims={"text": tampered})
    found = found.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::double)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::bigint AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
    SELECT p.a, p.b, p.score AS positive_score, s.b AS negative, s.score,
        row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS place
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, b AS positive_id, place::int AS rank, negative AS negative_id, positive_score, score AS negative_score
FROM n WHERE place <= 3
"""


@_query("op13_hard_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Three hard negatives of every positive of every fiftieth vector, out of all vectors; every seventh label is moved first."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.expr("vec_id % 50 = 0"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
