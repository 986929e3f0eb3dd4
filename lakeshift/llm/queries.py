"""One registered query per operator of this subpackage, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_digests
from .common import table
from .decontaminate import find_contamination
from .html_extract import extract_text
from .mixing import plan_mix
from .ngram_join import jaccard_components
from .quality_lm import score_quality
from .spelling import spelling_variants
from .stream_dedup import exact_dedup
from .tensor_minhash import near_duplicates
from .token_align import alignment_digests
from .token_output import token_digests
from .toxicity import score_toxicity
from .url_filter import judge_urls


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("locator")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold=90)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat_digests(turns.unionByName(extra))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_stream_dedup, op3_toxicity, op4_mix_sources, op5_ngram_jaccard, op6_chat_format, op7_url_filter, op8_decontaminate, op9_token_output, op10_quality_lm, op11_token_align, op12_tensor_minhash, op13_spelling_variants)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

def _jaccard(k: int, threshold: int, columns: str) -> str:
    """Components of documents whose sets of ``k``-word shingles have a similarity of ``threshold`` per cent or more."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle}))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
k AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS key, g FROM s),
sets AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM k WHERE n > 0 GROUP BY key),
t AS (SELECT rep, n, unnest(g) AS x FROM sets),
p AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {threshold} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a),
o AS (
  SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id
  FROM k LEFT JOIN sets ON k.n > 0 AND sets.key = k.key LEFT JOIN m ON m.rep = sets.rep)
SELECT doc_id, n_shingles, {columns} FROM o"""


SQL = {
    "op2_stream_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
    "op4_mix_sources": f"""
WITH rows AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per),
r AS (
  SELECT *, (SELECT sum(source_size) FROM per)::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS caps_before,
         coalesce(sum(weight) OVER before, 0) AS weight_before,
         sum(weight) OVER () AS weights
  FROM w WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, weight * ((total - caps_before) / (weights - weight_before)) >= 3.0::DOUBLE * source_size AS is_full FROM r),
level AS (
  SELECT (any_value(total) - coalesce(sum(3.0::DOUBLE * source_size) FILTER (is_full), 0)) / sum(weight) FILTER (NOT is_full) AS share FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN 3.0::DOUBLE * source_size ELSE weight * (SELECT share FROM level) END AS target FROM f),
k AS (
  SELECT rows.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY md5(concat_ws(':', '20', doc_id, size)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       least(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END, 3 * size)::BIGINT AS taken
FROM k""",
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role
            AND row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) > 1 AS goes_on FROM c)
SELECT conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length(replace(text, '<|', '<||')) + CASE WHEN goes_on THEN 8 ELSE 16 + length(replace(role, '<|', '<||')) END) + 16)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (
  SELECT p.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.rn ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rn FROM p) p
  LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op5_ngram_jaccard": _jaccard(3, 90, "component_id"),
    "op12_tensor_minhash": _jaccard(4, 80, "component_id, doc_id = component_id AS kept"),
    "op8_decontaminate": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'i', item_id, lower(text) FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(coalesce(t, ''), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM words),
m AS (SELECT DISTINCT least(len(w), 5) AS m FROM w WHERE kind = 'i' AND len(w) > 0),
g AS (
  SELECT kind, id, m, unnest(list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) AS x
  FROM w, m WHERE len(w) >= m AND (kind = 'd' OR m = least(len(w), 5))),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n)::INTEGER AS n_item_shingles, count(*)::INTEGER AS n_shared, count(*) / any_value(n.n)::DOUBLE AS containment
FROM g d JOIN g i ON d.kind = 'd' AND i.kind = 'i' AND d.m = i.m AND d.x = i.x JOIN n ON n.id = i.id
GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n.n)""",
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(doc || ':' || run)) AS h FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
lost AS (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE len(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
wild AS (SELECT word, n, i, word[:i - 1] AS before, word[i + 1:] AS after FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM wild a JOIN wild b ON a.i = b.i AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT w.word, v.word, v.n FROM wild w JOIN v ON v.word = w.before || w.after
  UNION SELECT v.word, w.word, w.n FROM wild w JOIN v ON v.word = w.before || w.after),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY 1),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.top AS root, f.n, f.n_near, f.form_n
FROM f JOIN r ON r.word = f.word JOIN f l ON l.word = r.top AND l.form IS NULL""",
}
