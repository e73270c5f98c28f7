"""Registered queries of the operators: ``key -> callable(spark, sf_dir)``."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import cap_filters, chat_format, decontaminate, katz, line_dedup, packing, part_enum, period_runs, secret_scan, sharding, toxicity, url_filter, vector_codes
from attrition.llm.common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(query):
        QUERIES[name] = query
        return query

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeats of lines that stand on many sites."""
    clean = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "text", "n_lines", "n_removed")


@register("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of every document."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.digests(pieces)


@register("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen runs of the documents along a Hilbert curve."""
    return sharding.document_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz back-off scores of every document."""
    return katz.katz_scores(table(spark, sf_dir, "documents"), order=katz.ORDER)


@register("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at 85 % Jaccard of four-word shingles."""
    return part_enum.jaccard_components(table(spark, sf_dir, "documents"))


@register("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of embeddings linked at a cosine of 0.9."""
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents contain."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def with_planted_period(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; those of every tenth id (by CRC-32) repeat with a period from some word on."""
    found = period_runs.split_words(doc_id, text)
    h, n = zlib.crc32(str(doc_id).encode()), len(found)
    if doc_id is None or h % 10 or not n:
        return found
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    cycle = found[first : first + period]
    return (found[:first] + cycle * (-(-(n - first) // period)))[:n]


@register("op11_period_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and the text without what they repeat."""
    found = period_runs.collapsed(table(spark, sf_dir, "documents"), with_planted_period)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    held = found.withColumn("longest", first)
    return held.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        (-F.col("longest.less")).alias("length"),
        "longest.period",
        F.expr("1000 * -longest.less div longest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register("op12_vector_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen-part codes of every embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = vector_codes.train(vectors)
    coded = vector_codes.encode(vectors, books).select("vec_id", "label", "code", "error")
    coded = staged(coded, "vector-codes")  # read twice below
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


@register("op13_chat_format")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that speaks in control strings, formatted and read back."""
    spoken = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.createDataFrame([(-1, 0, "user", spoken), (-1, 1, "assistant", spoken)], turns.schema)
    segments = chat_format.segments(turns.unionByName(said))
    return chat_format.read_back(segments).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"
    )


LINE_DEDUP_SQL = f"""
WITH cut AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), one AS (
  SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS place FROM cut
), line AS (
  SELECT doc_id, source, place, trim(raw) AS t FROM one WHERE regexp_matches(raw, '{line_dedup.INK}')
), boiler AS (
  SELECT t, arg_min(doc_id, (doc_id, place)) AS d0, arg_min(place, (doc_id, place)) AS a0
  FROM line GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), gone AS (
  SELECT DISTINCT l.doc_id, l.place FROM line l JOIN boiler b USING (t) WHERE (l.doc_id, l.place) <> (b.d0, b.a0)
), per AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT c.doc_id,
       array_to_string(list_transform(list_filter(range(len(c.parts)), lambda i: NOT list_contains(coalesce(p.places, []), i)),
                                      lambda i: c.parts[i + 1]), chr(10)) AS text,
       CAST(len(c.parts) AS INT) AS n_lines,
       CAST(len(coalesce(p.places, [])) AS INT) AS n_removed
FROM cut c LEFT JOIN per p USING (doc_id)
"""


CONTAINED_SQL = f"""
WITH word AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark
), shingle AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - {decontaminate.WORDS - 2}),
           lambda p: array_to_string(w[p:p + {decontaminate.WORDS - 1}], ' '))) AS s
  FROM word WHERE len(w) >= {decontaminate.WORDS}
), size AS (
  SELECT id AS item_id, count(*) AS n_item FROM shingle WHERE kind = 'i' GROUP BY id
), met AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingle d JOIN shingle i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item
FROM met JOIN size USING (item_id) WHERE 100 * n_shared >= {decontaminate.PERCENT} * n_item
"""


#: CRC-32 of a text in SQL: a register takes each byte and then eight bits.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""

PERIOD_RUNS_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         {CRC32_SQL.format("doc_id::VARCHAR")} AS h
  FROM documents
), place AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM cut
), word AS (
  SELECT doc_id, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS t
  FROM (SELECT *, unnest(range(n)) AS i FROM place)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.t = y.t AND x.i < y.i
), stretch AS (
  SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island HAVING max(i) + q + 1 - min(i) >= greatest(12, 2 * q)
), run AS (
  SELECT * FROM stretch r WHERE NOT EXISTS (
    SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.e >= r.e)
), per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min((s, e - s, q), (s - e, s, q)) AS top,
         sha256(string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q)) AS digest
  FROM run GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text FROM word w
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.e) GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period,
       1000 * top[2] // top[3] AS exponent_milli,
       coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM cut c LEFT JOIN per USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _nearest_sql(books: str) -> str:
    """Entry and squared distance nearest to each part."""
    return f"""SELECT vec_id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM part x JOIN {books} b USING (p)) GROUP BY vec_id, p"""


def _moved_sql(nearest: str, books: str) -> str:
    """Entries at the floored mean of their parts; unused ones as they were."""
    return f"""SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS v FROM (
      SELECT n.p, n.e, i, floor(sum(v[i]) / count(*))::BIGINT AS c
      FROM {nearest} n JOIN (SELECT vec_id, p, v, unnest(range(1, len(v) + 1)) AS i FROM part) x USING (vec_id, p) GROUP BY ALL)
    GROUP BY p, e) m USING (p, e)"""


VECTOR_CODES_SQL = f"""
WITH good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM (SELECT *, unnest(range(16)) AS p FROM good)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part
  QUALIFY e < 64
), near0 AS ({_nearest_sql("book0")}
), book1 AS ({_moved_sql("near0", "book0")}
), near1 AS ({_nearest_sql("book1")}
), book2 AS ({_moved_sql("near1", "book1")}
), near2 AS ({_nearest_sql("book2")}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY g.label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded c JOIN good g USING (vec_id)
"""


#: Characters that the template puts around a turn, and that escaping adds; valid orders are a pattern over the roles' initials.
CHAT_FORMAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), one AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<\\[\\\\]', '', 'g'))
    + CASE role WHEN 'user' THEN length('[INST] [/INST]') WHEN 'assistant' THEN length('[ANS] </s>') WHEN 'system' THEN length('[SYS] [/SYS]')
                ELSE length('[ROLE] [/ROLE][/TEXT]') + length(role) + length(regexp_replace(role, '[^<\\[\\\\]', '', 'g')) END AS n
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (length('<s>') + sum(n))::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'system' THEN 's' ELSE '?' END, ''
                                    ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM one GROUP BY conv_id
"""


def oracle_texts() -> dict[str, str]:
    return {
        "op3_line_dedup": LINE_DEDUP_SQL,
        "op9_decontamination": CONTAINED_SQL,
        "op11_period_runs": PERIOD_RUNS_SQL,
        "op12_vector_codes": VECTOR_CODES_SQL,
        "op13_chat_format": CHAT_FORMAT_SQL,
    }


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` on all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
