"""Queries of detection: spans in page, document and conversation texts, and in texts derived from other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, audit, detection
from ..operators.geometry import place_spans
from ..sources import derived
from ..sources.subtitles import in_window

LAST = "[.,;:!?)\\]}]+$"
ADDRESS = r"https?://[^ <>\"']+"
WWW = r"(^|[^a-z0-9_@])(www\.[a-z0-9.-]+[a-z])"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]"


def _spans(df, keys, kinds, policy=None, text="text"):
    """One row for each span of the kinds that detection finds: keys, start_char, end_char, found and the decision."""
    rows = detection.detect(df, text, policy or detection.Policy()).select(*keys, text, F.explode("spans").alias("s")).where(F.col("s.kind").isin(*kinds))
    found = F.substr(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select(*keys, F.col("s.start").cast("bigint").alias("start_char"), F.col("s.end").cast("bigint").alias("end_char"), found.alias("found"), "s.kind", "s.status", "s.reason")


PRIVATE = detection.Policy(privacy=True)


def _sql_spans(source: str, key: str, text: str, pattern: str, replacement: str = "(chr(1) || '\\0' || chr(1))") -> str:
    """SQL CTEs that do the same with markers: spans (key, start_char, found)."""
    quoted = pattern.replace("'", "''")
    return f"""parts AS (SELECT {key}, string_split(regexp_replace({text}, '{quoted}', {replacement}, 'g'), chr(1)) AS p FROM {source}),
spans AS (SELECT {key}, CAST(list_sum([length(x) FOR x IN p[1:2 * i + 1]]) AS BIGINT) AS start_char, p[2 * i + 2] AS found FROM parts, unnest(range(0, len(p) // 2)) t(i))"""


def scan_text_lines(spark, d):
    docs = derived.table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def _addresses(spark, d):
    return _spans(derived.table(spark, d, "pages").select("page_id", F.col("url").alias("text")), ["page_id"], ["http(s)"])


def address_spans_pages(spark, d):
    return _addresses(spark, d).select("page_id", "start_char", "end_char", "kind", "status", "reason")


def www_spans_html(spark, d):
    s = _spans(derived.table(spark, d, "pages").select("page_id", F.col("html").alias("text")), ["page_id"], ["www"])
    return s.select("page_id", "start_char", "end_char", F.sha2(F.lower("found"), 256).alias("found_sha256"))


def email_spans_docs(spark, d):
    return _spans(derived.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], ["email"], PRIVATE).select("doc_id", "start_char", "end_char", "kind")


PHONE = "printf('call tel: +%d (%03d) %04d, order %d', o_orderkey % 90 + 1, o_custkey % 1000, o_orderkey % 10000, o_orderkey)"


def labelled_phone_spans(spark, d):
    o = derived.table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.format_string("call tel: +%d (%03d) %04d, order %d", k % 90 + 1, F.col("o_custkey") % 1000, k % 10000, k)
    s = _spans(o.select("o_orderkey", text.alias("text")), ["o_orderkey"], ["phone"], PRIVATE).where("reason = 'privacy_labelled_phone'")
    return s.select("o_orderkey", "start_char", F.length(F.regexp_replace("found", "[^0-9]", "")).cast("bigint").alias("digits"))


def mobile_spans(spark, d):
    c = derived.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = F.format_string("+86 1%d%09d, id %d and 1%d%08d9", k % 10, k * 7919 % 1000000000, k, k % 8, k)
    s = _spans(c.select("c_custkey", text.alias("text")), ["c_custkey"], ["phone"], PRIVATE).where("reason = 'privacy_mobile_number'")
    return s.select("c_custkey", "start_char", "found")


PATH = "CASE c_custkey % 3 WHEN 0 THEN '/Users/' WHEN 1 THEN '/home/' ELSE 'C:\\Users\\' END"


def _paths(spark, d):
    k = F.col("c_custkey")
    root = F.when(k % 3 == 0, "/Users/").when(k % 3 == 1, "/home/").otherwise("C:\\Users\\")
    sep = F.when(k % 3 == 2, "\\").otherwise("/")
    text = F.concat(F.lit("open "), root, F.lower("c_mktsegment"), k.cast("string"), sep, F.lit("work"), sep, F.lit("notes.md now"))
    return derived.table(spark, d, "customer").select("c_custkey", text.alias("text"))


def _identity(spark, d, policy):
    rows = detection.detect(_paths(spark, d), "text", detection.Policy(privacy=True, path_policy=policy))
    rows = rows.select("c_custkey", F.explode("spans").alias("s")).where("s.kind = 'identity_path'")
    return rows.select("c_custkey", F.col("s.start").cast("bigint").alias("start_char"), F.col("s.end").cast("bigint").alias("end_char"), "s.status", "s.reason")


def identity_prefix_spans(spark, d):
    return _identity(spark, d, "identity-prefix")


def identity_parent_spans(spark, d):
    return _identity(spark, d, "parent")


def host_policy_prefix(spark, d):
    pages = derived.table(spark, d, "pages").select("page_id", F.concat(F.lit("see https://code.example/"), F.regexp_replace("url", "^https?://", "")).alias("text"))
    rows = detection.detect(pages, "text", detection.Policy(host_policy="host", retained_host="code.example")).select("page_id", F.explode("spans").alias("s"))
    return rows.select("page_id", F.col("s.start").cast("bigint").alias("start_char"), F.col("s.end").cast("bigint").alias("end_char"), "s.kind", "s.reason")


def file_extension_keep(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("py", "md", "com", "zz", "org", "json")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = derived.table(spark, d, "part").select("p_partkey", F.concat(F.lit("see "), F.translate("p_name", " ", "-"), F.lit("."), ext, F.lit(" there")).alias("text"))
    found = detection.detect(rows).select("p_partkey", F.explode("spans").alias("s"))
    return found.select("p_partkey", F.col("s.start").cast("bigint").alias("start_char"), F.col("s.end").cast("bigint").alias("end_char"), "s.status", "s.reason")


def tld_filter_domains(spark, d):
    """Hosts of pages whose last label is a known suffix: a semi-join with a bounded dimension."""
    pages = derived.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))
    pages = pages.withColumn("suffix", F.lower(F.element_at(F.split("host", "[.]"), -1)))
    known = spark.createDataFrame([(t,) for t in sorted(detection.Policy().suffixes)], "suffix string")
    return pages.join(F.broadcast(known), "suffix", "left_semi").select("page_id", "host", "suffix")


def email_overlap_antijoin(spark, d):
    """Names that are not part of an e-mail address, in texts that hold each page's host in both ways."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    pages = derived.table(spark, d, "pages").select("page_id", F.concat(F.lit("mail a"), F.col("page_id"), F.lit("@"), host, F.lit(" or "), host, F.lit(", now")).alias("text"))
    return _spans(pages, ["page_id"], ["domain", "www"]).select("page_id", "start_char", "end_char")


def numeric_heading_review(spark, d):
    rows = derived.table(spark, d, "supplier").select("s_suppkey", F.format_string("%d.chapter.com and item%d.com", F.col("s_suppkey"), F.col("s_suppkey")).alias("text"))
    found = detection.detect(rows).select("s_suppkey", F.explode("spans").alias("s"))
    return found.select("s_suppkey", F.col("s.start").cast("bigint").alias("start_char"), "s.status", "s.reason")


AUDIO = detection.Policy(privacy=True, channel="audio")


def spoken_number_normalize(spark, d):
    number = F.concat(F.lit("1"), (F.col("o_orderkey") % 10).cast("string"), F.lpad((F.col("o_orderkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    rows = derived.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("打 "), F.translate(number, "0123456789", "零一二三四五六七八九"), F.lit(" 吧")).alias("text"))
    s = _spans(rows, ["o_orderkey"], ["phone"], AUDIO)
    return s.select("o_orderkey", "start_char", "end_char", F.translate("found", "零〇一幺二两三四五六七八九", "0011223456789").alias("number"), "status", "reason")


CUES = ("email", "加我", "WeChat", "")


def contact_cue_segments(spark, d):
    """What is said about contacts: a cue before every turn but each fourth, then the turn's text."""
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (F.col("turn") % 4 + 1).cast("int"))
    rows = derived.table(spark, d, "conversations").select("conv_id", "turn", F.concat(cue, F.lit(": "), F.coalesce("text", F.lit(""))).alias("text"))
    return _spans(rows, ["conv_id", "turn"], ["contact_cue"], detection.Policy(privacy=True, channel="subtitle")).select("conv_id", "turn", "start_char", "status", "reason")


def confidence_gate(spark, d):
    e = F.col("event_id")
    rows = derived.table(spark, d, "events").select(
        "event_id", F.when(e % 3 == 0, "http(s)").when(e % 3 == 1, "domain").otherwise("identity_path").alias("kind"), F.when(e % 5 == 0, "keep").otherwise("mask").alias("status"),
        F.when(e % 7 == 0, "github_host_policy").otherwise("visible_address").alias("reason"), F.when(e % 4 == 0, "line_fallback").otherwise("characters").alias("box_method"),
        (e % 2 == 0).alias("covers_text"), F.when(e % 11 == 0, "vision_fast").alias("geometry_engine"), (F.col("value") / 40).alias("confidence"),
    )
    return detection.decide(rows).select("event_id", "kind", "status", "reason")


def candidate_status_summary(spark, d):
    return audit.status_summary(_addresses(spark, d), ["kind"])


def ledger_public_projection(spark, d):
    rows = _addresses(spark, d).withColumn("status", F.when(F.col("page_id") % 3 == 0, "keep").otherwise(F.col("status")))
    return detection.public_ledger(audit.pending(rows, ["page_id", "start_char"]).drop("found", "start_char", "end_char")).select("finding_id", "page_id", "kind", "status", "reason")


def identity_dense_ids(spark, d):
    rows = derived.table(spark, d, "pages").select((F.col("page_id") % 5).alias("source_id"), "page_id", F.sha2(F.regexp_extract("url", "^https?://([^/:?#]+)", 1), 256).alias("key"))
    return detection.anonymous_ids(rows, ["key"], ["page_id"], "source_id").select("source_id", "page_id", "anonymous_id")


def adjacent_fragment_hints(spark, d):
    """Each page's host in two pieces on the lines of a frame, below each other, beside, or too far apart."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    k = F.col("page_id")
    rows = derived.table(spark, d, "pages").select("page_id", F.array(F.regexp_replace(host, "[^.]+$", ""), F.concat(F.regexp_extract(host, "([^.]+)$", 1), F.lit(" here"))).alias("pieces"))
    rows = rows.select((k % 5).alias("source_id"), k.alias("frame"), F.posexplode("pieces").alias("obs_idx", "text"))
    second = F.col("obs_idx") == 1
    box = F.struct(F.when(second & (F.col("frame") % 3 == 1), 0.5).otherwise(0.125).alias("x"), F.when(second & (F.col("frame") % 3 != 1), F.when(F.col("frame") % 3 == 0, 0.375).otherwise(0.75)).otherwise(0.25).alias("y"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h"))
    rows = rows.select("source_id", "frame", "obs_idx", "text", box.alias("box"), F.when(second, 0.5).otherwise(0.75).alias("confidence"))
    return alignment.split_addresses(rows).select("source_id", "frame", "obs_idx", "other", "box.y", "box.w", "confidence", "kind", "reason")


def window_clip_segments(spark, d):
    rows = derived.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 1500).alias("start_ms"), (F.col("turn") * 1500 + 400 + F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("end_ms"))
    return in_window(rows, 2000, 9000, 250).select("conv_id", "turn", "start_ms", "end_ms")


def observation_candidates(spark, d):
    """The whole way of an observation: spans, geometry from its glyphs, decision."""
    k = F.col("s_suppkey")
    rows = derived.table(spark, d, "supplier").select("s_suppkey", F.format_string("go www.shop%d.com or mail a%d@b.org", k, k).alias("text"), (k % 10 / 10).alias("confidence"))
    n = F.length("text")
    unit = F.lit(0.9) / n
    glyph = lambda i: F.struct(i.alias("start"), (i + 1).alias("end"), F.struct((F.lit(0.05) + i * unit).alias("x"), F.lit(0.4).alias("y"), unit.alias("w"), F.lit(0.05).alias("h")).alias("box"))
    rows = rows.withColumns({"box": F.struct(F.lit(0.05).alias("x"), F.lit(0.4).alias("y"), F.lit(0.9).alias("w"), F.lit(0.05).alias("h")), "chars": F.transform(F.sequence(F.lit(0), n - 1), glyph)})
    spans = detection.detect(rows, "text", detection.Policy(privacy=True)).withColumn("s", F.explode("spans")).select("*", "s.*")
    placed = place_spans(spans, 1920, 1080).withColumns({"covers_text": F.lit(False), "geometry_engine": F.lit(None).cast("string")})
    return detection.decide(placed).select("s_suppkey", "kind", "status", "reason", "box_method", *[F.col(f"pixel_box.{c}").alias(c) for c in "xywh"])


QUERIES = {f.__name__: f for f in (scan_text_lines, address_spans_pages, www_spans_html, email_spans_docs, labelled_phone_spans, mobile_spans, identity_prefix_spans, identity_parent_spans, host_policy_prefix, file_extension_keep, tld_filter_domains, email_overlap_antijoin, numeric_heading_review, spoken_number_normalize, contact_cue_segments, confidence_gate, candidate_status_summary, ledger_public_projection, identity_dense_ids, adjacent_fragment_hints, window_clip_segments, observation_candidates)}

_ADDRESS = _sql_spans("pages", "page_id", "coalesce(url, '')", ADDRESS) + f", trimmed AS (SELECT page_id, start_char, regexp_replace(found, '{LAST}', '') AS found FROM spans)"
_IDENTITY = f"""WITH p AS (SELECT c_custkey, {PATH} AS root, lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) AS name FROM customer)
SELECT c_custkey, CAST(5 AS BIGINT) AS start_char, CAST(5 + length(root) + length(name) + {{tail}} AS BIGINT) AS end_char, 'mask' AS status, '{{reason}}' AS reason FROM p"""

ORACLES = {
    "scan_text_lines": "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), e AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS t FROM l) SELECT doc_id, CAST(line AS BIGINT) AS line, length(t) AS n_chars, sha256(t) AS text_sha256 FROM e",
    "address_spans_pages": f"WITH {_ADDRESS} SELECT page_id, start_char, start_char + length(found) AS end_char, 'http(s)' AS kind, 'mask' AS status, 'visible_address' AS reason FROM trimmed",
    "www_spans_html": f"WITH {_sql_spans('pages', 'page_id', "lower(coalesce(html, ''))", WWW, "('\\1' || chr(1) || '\\2' || chr(1))")} SELECT page_id, start_char, start_char + length(found) AS end_char, sha256(found) AS found_sha256 FROM spans",
    "email_spans_docs": f"WITH {_sql_spans('documents', 'doc_id', "coalesce(text, '')", MAIL)} SELECT doc_id, start_char, start_char + length(found) AS end_char, 'email' AS kind FROM spans",
    "labelled_phone_spans": f"""WITH o AS (SELECT o_orderkey, {PHONE} AS t FROM orders), {_sql_spans('o', 'o_orderkey', 't', r'(tel: )(\+?[0-9][0-9 ()-]{5,23}[0-9])', "('\\1' || chr(1) || '\\2' || chr(1))")}
SELECT o_orderkey, start_char, length(regexp_replace(found, '[^0-9]', '', 'g')) AS digits FROM spans WHERE length(regexp_replace(found, '[^0-9]', '', 'g')) BETWEEN 7 AND 15""",
    "mobile_spans": """WITH c AS (SELECT c_custkey, printf('1%d%09d', c_custkey % 10, c_custkey * 7919 % 1000000000) AS n, printf('1%d%08d9', c_custkey % 8, c_custkey) AS m FROM customer)
SELECT c_custkey, CAST(0 AS BIGINT) AS start_char, '+86 ' || n AS found FROM c WHERE regexp_full_match(n, '1[3-9][0-9]{9}')
UNION ALL SELECT c_custkey, CAST(25 + length(printf('%d', c_custkey)) AS BIGINT), m FROM c WHERE regexp_full_match(m, '1[3-9][0-9]{9}')""",
    "identity_prefix_spans": _IDENTITY.format(tail=1, reason="privacy_identity_prefix"),
    "identity_parent_spans": _IDENTITY.format(tail=6, reason="privacy_path_parent"),
    "host_policy_prefix": "SELECT page_id, CAST(4 AS BIGINT) AS start_char, CAST(24 AS BIGINT) AS end_char, 'http(s)' AS kind, 'github_host_policy' AS reason FROM pages",
    "file_extension_keep": """WITH p AS (SELECT p_partkey, ['py', 'md', 'com', 'zz', 'org', 'json'][p_partkey % 6 + 1] AS ext, length(p_name) AS n FROM part)
SELECT p_partkey, CAST(4 AS BIGINT) AS start_char, CAST(5 + n + length(ext) AS BIGINT) AS end_char, CASE WHEN ext IN ('com', 'org') THEN 'mask' ELSE 'keep' END AS status, CASE WHEN ext IN ('com', 'org') THEN 'visible_address' ELSE 'ordinary_file_extension' END AS reason FROM p WHERE ext <> 'zz'""",
    "tld_filter_domains": f"WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages), q AS (SELECT *, lower(string_split(host, '.')[-1]) AS suffix FROM p) SELECT * FROM q WHERE suffix IN {tuple(sorted(detection.Policy().suffixes))}",
    "email_overlap_antijoin": """WITH p AS (SELECT page_id, length(CAST(page_id AS VARCHAR)) AS k, length(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS n FROM pages)
SELECT page_id, CAST(11 + k + n AS BIGINT) AS start_char, CAST(11 + k + 2 * n AS BIGINT) AS end_char FROM p""",
    "numeric_heading_review": """SELECT s_suppkey, CAST(0 AS BIGINT) AS start_char, 'needs_review' AS status, 'numeric_heading_or_domain' AS reason FROM supplier
UNION ALL SELECT s_suppkey, CAST(length(CAST(s_suppkey AS VARCHAR)) + 17 AS BIGINT), 'mask', 'visible_address' FROM supplier""",
    "spoken_number_normalize": "WITH o AS (SELECT o_orderkey, '1' || CAST(o_orderkey % 10 AS VARCHAR) || lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS number FROM orders) SELECT o_orderkey, CAST(2 AS BIGINT) AS start_char, CAST(13 AS BIGINT) AS end_char, number, 'needs_review' AS status, 'spoken_number_requires_listening' AS reason FROM o WHERE regexp_full_match(number, '1[3-9][0-9]{9}')",
    "contact_cue_segments": f"""WITH c AS (SELECT conv_id, turn, {list(CUES)}[turn % 4 + 1] || ': ' || coalesce(text, '') AS t FROM conversations),
{_sql_spans('c', 'conv_id, turn', 't', '(?i)' + '|'.join(detection.CONTACT_CUES))}
SELECT conv_id, turn, start_char, 'needs_review' AS status, 'spoken_contact_context_required' AS reason FROM spans""",
    "confidence_gate": """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'http(s)' WHEN 1 THEN 'domain' ELSE 'identity_path' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'keep' ELSE 'mask' END AS status, CASE WHEN event_id % 7 = 0 THEN 'github_host_policy' ELSE 'visible_address' END AS reason,
  event_id % 4 = 0 AS rough, event_id % 2 = 0 AS whole, event_id % 11 = 0 AS fast, value / 40 < 0.5 AS weak FROM events),
r AS (SELECT *, CASE WHEN reason = 'github_host_policy' AND rough THEN 'retained_suffix_requires_precise_geometry' WHEN kind = 'identity_path' AND rough AND NOT whole THEN 'identity_prefix_requires_precise_geometry'
  WHEN status = 'mask' AND fast THEN 'independent_geometry_requires_review' WHEN status = 'mask' AND weak AND kind <> 'http(s)' THEN 'low_ocr_confidence' END AS why FROM e)
SELECT event_id, kind, CASE WHEN why IS NULL THEN status ELSE 'needs_review' END AS status, coalesce(why, reason) AS reason FROM r""",
    "candidate_status_summary": f"WITH {_ADDRESS} SELECT 'http(s)' AS kind, count(*) AS mask, CAST(0 AS BIGINT) AS needs_review, CAST(0 AS BIGINT) AS keep, 'not_verified' AS acceptance FROM trimmed",
    "ledger_public_projection": f"WITH {_ADDRESS} SELECT printf('R%06d', row_number() OVER (ORDER BY page_id, start_char)) AS finding_id, page_id, 'http(s)' AS kind, 'mask' AS status, 'visible_address' AS reason FROM trimmed WHERE page_id % 3 <> 0",
    "identity_dense_ids": """WITH p AS (SELECT page_id % 5 AS source_id, page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS k FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY source_id, k) AS m FROM p)
SELECT source_id, page_id, printf('U%03d', dense_rank() OVER (PARTITION BY source_id ORDER BY m)) AS anonymous_id FROM f""",
    "adjacent_fragment_hints": """SELECT page_id % 5 AS source_id, page_id AS frame, 0 AS obs_idx, 1 AS other, 0.25::DOUBLE AS y, CASE page_id % 3 WHEN 1 THEN 0.625 ELSE 0.25 END::DOUBLE AS w, 0.5::DOUBLE AS confidence, 'split_address' AS kind, 'adjacent_fragments_need_visual_review' AS reason FROM pages WHERE page_id % 3 <> 2""",
    "observation_candidates": """WITH s AS (SELECT s_suppkey, s_suppkey % 10 / 10 AS confidence, length(CAST(s_suppkey AS VARCHAR)) AS k FROM supplier),
t AS (SELECT *, 2 * k + 31 AS n, [{'kind': 'www', 'a': 3, 'b': 15 + k}, {'kind': 'email', 'a': 24 + k, 'b': 31 + 2 * k}] AS v FROM s), u AS (SELECT s_suppkey, confidence, n, unnest(v) AS s FROM t),
g AS (SELECT *, 0.9::DOUBLE / n AS unit, s.kind AS kind FROM u), h AS (SELECT *, 0.05::DOUBLE + s.a * unit AS x, 0.05::DOUBLE + (s.b - 1) * unit + unit AS r, (0.05::DOUBLE + (s.a - 1) * unit + unit) * 1920 AS before, (0.05::DOUBLE + s.b * unit) * 1920 AS after FROM g),
i AS (SELECT *, greatest(floor(x * 1920 - 4), ceil(before)) AS x1, CASE WHEN s.b = n THEN ceil(x * 1920 + (r - x) * 1920 + 4) ELSE least(ceil(x * 1920 + (r - x) * 1920 + 4), floor(after)) END AS x2, kind = 'email' AND confidence < 0.5 AS weak FROM h)
SELECT s_suppkey, kind, CASE WHEN weak THEN 'needs_review' ELSE 'mask' END AS status, CASE WHEN weak THEN 'low_ocr_confidence' WHEN kind = 'www' THEN 'visible_address' ELSE 'privacy_email' END AS reason, 'characters' AS box_method,
  CAST(x1 AS BIGINT) AS x, CAST(428 AS BIGINT) AS y, CAST(x2 - x1 AS BIGINT) AS w, CAST(62 AS BIGINT) AS h FROM i""",
    "window_clip_segments": """WITH c AS (SELECT conv_id, turn, turn * 1500 + 250 AS a, turn * 1500 + 650 + length(coalesce(text, '')) AS b FROM conversations)
SELECT conv_id, turn, greatest(a, 2000) AS start_ms, least(b, 9000) AS end_ms FROM c WHERE b > 2000 AND a < 9000""",
}
