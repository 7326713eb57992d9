"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, language, licenses, linededup, mixing, neardup, quality, resampling, secrets, spelling, tokens, warc
from .common import read_table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(read_table(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_covered")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(read_table(spark, sf_dir, "documents")).select("doc_id", "license", "shared", "n_template")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_packages(read_table(spark, sf_dir, "pages"))
    return warc.read_packages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_shards(read_table(spark, sf_dir, "documents"), default_tokenizer())
    return tokens.read_shards(spark, path)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.without_frequent_lines(read_table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secret_scans": op2_secret_scans,
    "op3_html_extraction": op3_html_extraction,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_license_scans": op6_license_scans,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_token_output": op9_token_output,
    "op10_quality_rules": op10_quality_rules,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NIBBLES = ", ".join(f"'{i:04b}'" for i in range(16))
_BITS = " + ".join(f"{1 << 4 - k} * CAST(substr(b, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))


def _span_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the text between matches and the matches, by length, give their places."""
    return rf"""SELECT doc_id, '{kind}' AS kind, lo, lo + length(m[i]) AS hi FROM (SELECT *, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS lo
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d)) WHERE length(g[i]) >= {least})"""


_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SPANS = " UNION ALL ".join((
    _span_sql("assign", rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    _span_sql("access", "AKIA[A-Z0-9]+", 0, 18),
    _span_sql("hex", "[0-9a-f]+", 0, 16),
    _span_sql("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    _span_sql("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
))
_LISTED = "string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, list_position(['assign', 'access', 'hex', 'pem', 'jwt'], kind))"

_TEMPLATES = ", ".join(f"('{k}', {licenses.template_words(t)}, {2 * n + licenses.window_length(n)})" for k, t in licenses.TEMPLATES.items() for n in [len(licenses.template_words(t)) - licenses.SHINGLE + 1])

#: The SQL of white space, of the bytes of a string and of its CRC-32, bit by bit.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc_sql(value: str) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', hex({value})[{at}]) - 1)"
    bits = f"list_transform(range(0, 8 * octet_length(encode({value}))), lambda i: CASE WHEN i % 8 = 0 THEN 16 * {digit('i // 4 + 1')} + {digit('i // 4 + 2')} ELSE 0 END)"
    return f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295)"


_FEATURES = r"""(SELECT doc_id, w, list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
 FROM (SELECT {id} AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}))"""
_DOC_FEATURES, _TARGET_FEATURES = (_FEATURES.format(id=i, table=t, up=_UPPER, low=_LOWER) for i, t in (("doc_id", "documents"), ("item_id", "benchmark")))

ORACLES: dict[str, str] = {
    "op11_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, {_WHITE}), '{_UPPER}', '{_LOWER}')) AS k FROM d),
 f AS (SELECT g FROM (SELECT doc_id, unnest(k) AS g FROM k) WHERE length(g) >= 1 GROUP BY g HAVING count(DISTINCT doc_id) >= 10),
 e AS (SELECT doc_id, unnest(l) AS line, unnest(k) AS g, unnest(range(1, len(l) + 1)) AS pos FROM k)
 SELECT doc_id, count(*) AS n_lines, count(f.g) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.g IS NULL), '')) AS kept_sha256 FROM e LEFT JOIN f ON e.g = f.g GROUP BY doc_id""",
    # Words with a common rest after one deletion: replacements at one place, or one word being the other's rest.
    "op12_spelling_variants": f"""WITH RECURSIVE o AS (SELECT doc_id, r, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
 h AS (SELECT r, n, {_crc_sql("(doc_id || ':' || r)")} AS h FROM o),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 x AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN x b ON a.word = b.rest UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN x b ON a.word = b.rest),
 q AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY ALL),
 f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN q USING (word)),
 t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word) JOIN f g ON g.word = t.root WHERE g.form IS NULL""",
    "op13_importance_resampling": f"""WITH d AS {_DOC_FEATURES}, b AS {_TARGET_FEATURES},
 df AS (SELECT doc_id, unnest(f) AS f FROM d), bf AS (SELECT unnest(f) AS f FROM b),
 h AS (SELECT f, {_crc_sql("f")} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
 s AS (SELECT k, count(*) AS s FROM df JOIN h USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bf JOIN h USING (f) GROUP BY k),
 z AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS sz, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tz),
 g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sz + 10000) / ((s + 1)::DOUBLE * (tz + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), z),
 w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY doc_id),
 v AS (SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8] AS x FROM d LEFT JOIN w USING (doc_id)),
 u AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || x)::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM u WHERE n_words >= 20)
 SELECT u.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM u LEFT JOIN r USING (doc_id)""",
    # Shingles of a template that stand within the reach of a window, from any of them on.
    "op6_license_scans": rf"""WITH t AS (SELECT name, far, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM (VALUES {_TEMPLATES}) AS v(name, w, far)),
 w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
 hit AS (SELECT doc_id, name, far, i, g FROM s JOIN t USING (g)),
 near AS (SELECT a.doc_id, a.name, a.i, count(DISTINCT b.g) AS shared FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.name = b.name AND b.i BETWEEN a.i AND a.i + a.far GROUP BY ALL),
 size AS (SELECT name, count(*) AS n_template FROM t GROUP BY name)
 SELECT doc_id, name AS license, max(shared) AS shared, n_template FROM near JOIN size USING (name) WHERE shared >= ceil({licenses.CONTAINED} * n_template) GROUP BY ALL""",
    "op2_secret_scans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SPANS}),
 n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_LISTED} FILTER (kind IN ('assign', 'access', 'hex')) AS base, {_LISTED} AS spans FROM s GROUP BY doc_id)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (doc_id)""",
    "op4_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
 arc AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT doc_id, b FROM reach JOIN arc ON far = a),
 comp AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_warc": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
 d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m, array_to_string(list_transform(range(1, 41), lambda i: [{_NIBBLES}][strpos('0123456789abcdef', substr(sha1(h), i, 1))]), '') AS b FROM p)
 SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
 CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to, url FROM d""",
}
