"""The opN_ queries: each applies its operator to its whole table and derives the digest columns. SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, merkle, packing, quality, ranked_search, substring_dedup, suffix_array_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.similar_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Fixed by the query's definition: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_from(spark, URL_RULES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), crc32=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup.deduplicate_passages(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    lines_joined = columns | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = F.when(tampered, merkle.leaf_digest(list(lines_joined.values()))).otherwise(merkle.leaf_digest(list(columns.values())))
    out = merkle.manifest(table(spark, sf_dir, "documents"), carry={"now": F.unhex(now)})
    out = out.select("doc_id", *[merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def known_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of operator 6 with a reference of its own: passages of eight words of the benchmark leave the documents."""
    out = substring_dedup.remove_known(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_ALL = (op1_decontaminate, op2_language_id, op3_exact_dedup, op4_line_dedup, op5_jaccard_join, op6_substring_dedup, op7_url_filter, op8_packing, op9_quality, op10_suffix_array_dedup, op11_merkle_manifest, op12_fingerprints, op13_ranked_search, known_passages)
QUERIES = {f.__name__: f for f in _ALL}

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER


def _repeats_sql(window: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {window - 1}), ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w WHERE len(ws) >= {window})),
f AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS j FROM f WHERE (doc_id, i) > first),
k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
r AS (SELECT k.doc_id, count(c.j) AS removed, string_agg(word, ' ' ORDER BY k.j) FILTER (c.j IS NULL) AS kept
      FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.j = c.j GROUP BY k.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""


def _written(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


#: crc32 of the decimal id, bit by bit: DuckDB has no function for it.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x:
      list_reduce(list_prepend(xor(c, x), range(8)), lambda h, i: xor(h >> 1, CASE WHEN h % 2 = 1 THEN 3988292384 ELSE 0 END))))"""


SQL = {
    "op1_decontaminate": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n),
h AS (SELECT doc_id, item_id, i, d.n FROM (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase FROM d) d JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id""",
    "op5_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)""",
    "op6_substring_dedup": _repeats_sql(20),
    "op10_suffix_array_dedup": _repeats_sql(50),
    "known_passages": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT ws, unnest(range(1, len(ws) - 6)) AS i FROM b WHERE len(ws) >= 8)),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM g SEMI JOIN p USING (g)),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
r AS (SELECT k.doc_id, count(c.j) AS removed, string_agg(word, ' ' ORDER BY k.j) FILTER (c.j IS NULL) AS kept FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.j = c.j GROUP BY k.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)""",
    "op7_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
v AS (SELECT page_id, regexp_extract(r, '^([^?#]*)', 1) AS b FROM u),
p AS (SELECT page_id, translate(regexp_extract(b, '^([^/]*)', 1), '{UPPER}', '{LOWER}') AS host, substr(b, length(regexp_extract(b, '^([^/]*)', 1)) + 1) AS path FROM v),
l(verdict, h, q) AS (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in URL_RULES)}),
m AS (SELECT page_id, host, path, max(struct_pack(n := length(h || q), rule := h || q, verdict := l.verdict)) FILTER (h IS NOT NULL) AS best
      FROM p LEFT JOIN l ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE v AS (SELECT doc_id, source, {_written("doc_id::VARCHAR")} || {_written("source")} || {_written("lang")} || {_written("n_chars::VARCHAR")} AS head,
      text, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
r AS (SELECT doc_id, source, sha256(head || {_written("text")}) AS leaf, sha256(head || {_written("now")}) AS forged,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM v),
t(source, level, pos, n, digest) AS (
      SELECT source, 0, pos, n, leaf FROM r UNION ALL
      SELECT source, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, level, pos // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, n, digest) AS (
      SELECT 0, pos, n, subroot FROM s UNION ALL
      SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3),
f(doc_id, source, level, pos, n, own, others) AS (
      SELECT doc_id, source, 0, pos, n, forged, '' FROM r UNION ALL
      SELECT f.doc_id, f.source, any_value(f.level) + 1, any_value(f.pos) // 3, (any_value(f.n) + 2) // 3,
             sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.own ELSE t.digest END, '' ORDER BY t.pos)),
             any_value(f.others) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
      FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.source),
g(doc_id, level, pos, n, own, others) AS (
      SELECT f.doc_id, 0, s.pos, s.n, f.own, f.others FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1 UNION ALL
      SELECT g.doc_id, any_value(g.level) + 1, any_value(g.pos) // 3, (any_value(g.n) + 2) // 3,
             sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.own ELSE u.digest END, '' ORDER BY u.pos)),
             any_value(g.others) || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> g.pos), '')
      FROM g JOIN u ON u.level = g.level AND u.pos // 3 = g.pos // 3 WHERE g.n > 1 GROUP BY g.doc_id)
SELECT r.doc_id, r.leaf, s.subroot, u.digest AS root, sha256(g.others) AS proof_sha256, g.own AS folded_root, g.own = u.digest AS verified
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN g ON g.doc_id = r.doc_id AND g.n = 1 JOIN u ON u.n = 1""",
    "op13_ranked_search": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
t AS (SELECT doc_id, any_value(len(ws)) AS n, term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM w) GROUP BY doc_id, term),
c AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM w WHERE len(ws) > 0),
d AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM (SELECT item_id, unnest(ws) AS term FROM b) JOIN t USING (term) JOIN d USING (term), c GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10""",
}
