"""The queries of this folder: each applies its operator to whole tables and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, decontamination, exact_dedup, licences, ngram_join, packing, quality, token_counts, toxicity, warc
from .common import crc32_mod, scratch_dir, table


#: Scores from here on count as label 1.
QUALITY_LEAST = TOXIC_LEAST = 0.7


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.piece_scores(vocabulary("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), scores)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.matches(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels, crc32_mod("doc_id", 3) != 1)
    held = (crc32_mod("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs, lexicon).select("doc_id", held, "score", (F.col("score") >= TOXIC_LEAST).cast("int").alias("predicted"), "weight")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = f"{scratch_dir(spark)}/warc", table(spark, sf_dir, "pages")
    warc.write(pages, folder)
    # Every URL is looked up in the index, which gives each record once.
    return warc.read(spark, folder, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, crc32_mod("doc_id", 4) != 2)
    held = (crc32_mod("doc_id", 4) == 2).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(-(2**63))))
    # A conversation is a tree with one branch: each turn answers the one before it.
    before = Window.partitionBy("conv_id").orderBy("turn")
    steps = rows.select("conv_id", "turn").distinct().withColumn("parent", F.lag("turn").over(before))
    nodes = steps.select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), "parent", F.lit(0.0).alias("score"))
    messages = rows.select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), "role", "text")
    return chat.digests(chat.format_paths(messages, best=None, nodes=nodes)).withColumnRenamed("tree", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_chat_formatting": op10_chat_formatting,
}

#: Texts are equal by their normal form, so its SHA-256 stands for the group.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


#: What reading the archives back must give; base32 of the SHA-1 is spelled from its bits.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, x, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    list_transform(range(0, 40), lambda i: (strpos('0123456789abcdef', x[i + 1]) - 1)) AS v FROM p
), b AS (
  SELECT page_id, x, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(0, 5), lambda j: ((v[(5 * k + j) // 4 + 1] >> (3 - (5 * k + j) % 4)) & 1) << (4 - j)))::INT, 1)), '') AS payload_digest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY x)
"""

#: The template is reversible, so its text's length follows from what it escapes.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '\\|###|</turn>|\n')) AS x, length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) AS y FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + x + 2 + y + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Shared shingles of all pairs, and what links reach: quadratic in shared passages, so for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM g), s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id
"""

#: Equal words of all documents and items by their shift; a window of 13 aligned words decides.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS nd, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS word FROM d),
bw AS (SELECT item_id, len(w) AS ni, generate_subscripts(w, 1) - 1 AS q, unnest(w) AS word FROM b),
m AS (SELECT doc_id, item_id, p - q AS shift, p, nd, ni FROM dw JOIN bw USING (word) WHERE word <> ''),
g AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING 100 * count(*) >= 80 * least(13, min(ni))),
k AS (SELECT m.*, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM m SEMI JOIN g USING (doc_id, item_id, shift)),
r AS (SELECT doc_id, item_id, shift, ni, count(*) AS matched, max(c) AS best FROM k WHERE least(shift + ni, nd) - greatest(shift, 0) >= least(13, ni) GROUP BY ALL)
SELECT doc_id, item_id, matched AS matched_words, CAST(ni AS BIGINT) AS item_words, CAST(shift AS BIGINT) AS word_shift FROM r
WHERE 100 * best >= 80 * least(13, ni) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift, ni DESC) = 1
"""


def _op2_sql() -> str:
    """Every unit against every template, by the definition."""
    rows = ", ".join("('" + name + "', [" + ", ".join("'" + b + "'" for b in g) + "])" for name, t in licences.TEMPLATES.items() if (g := licences.bigrams(t)))
    return rf"""
WITH t(template, tg) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS text FROM documents),
l AS (SELECT doc_id, string_split(text, chr(10)) AS us FROM d),
b AS (SELECT doc_id, string_split_regex(text, '\n *\n') AS us FROM d),
u AS (
  SELECT doc_id, 'line' AS unit_kind, generate_subscripts(us, 1) - 1 AS unit, unnest(us) AS u FROM l
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'block' AS unit_kind, generate_subscripts(us, 1) - 1 AS unit, unnest(us) AS u FROM b) WHERE contains(u, chr(10))
),
w AS (SELECT doc_id, unit_kind, unit, string_split(trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, unit_kind, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
s AS (
  SELECT doc_id, unit_kind, unit, template, len(list_intersect(g, tg)) AS i, len(g) + len(tg) AS n
  FROM g, t WHERE list_has_any(g, tg)
)
SELECT doc_id, unit_kind, CAST(unit AS BIGINT) AS unit, template, CAST(2000 * i // n AS BIGINT) AS dice
FROM s WHERE 200 * i >= {licences.THRESHOLD} * n
QUALIFY row_number() OVER (PARTITION BY doc_id, unit_kind, unit ORDER BY 2000 * i // n DESC, template) = 1
"""


ORACLES: dict[str, str] = {"op2_license_scan": _op2_sql(), "op6_exact_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op10_chat_formatting": OP10_SQL, "op5_benchmark_decontamination": OP5_SQL, "op9_ngram_join": OP9_SQL}
