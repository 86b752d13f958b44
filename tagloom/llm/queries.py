"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, codes, fingerprints, language, lines, mixing, packing, repeats, search, simhash, tokens, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages", "page_id", "url")).withColumn("score", F.round("score", 6))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queue(_read(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return search.top_k(docs, docs.where(F.col("doc_id") % 50 == 0)).withColumn("score", F.round("score", 6))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (lang attribute, host, suffix) in one fusion."""
    documents = language.evidence(_read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), "doc_id", "text", "lang", "source", origin="documents")
    pages = language.evidence(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", None, None, None, "url", "html", origin="pages")
    of = lambda name: F.when(F.col("origin") == name, F.col("id"))
    out = language.fuse(documents.unionByName(pages))
    return out.select(of("documents").alias("doc_id"), of("pages").alias("page_id"), "lang", "confidence", "text_lang", "declared", "accepted")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeats(_read(spark, sf_dir, "documents", "doc_id", "text"), keep="sha256")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = codes.compress_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergence(_read(spark, sf_dir, "documents", "text", "lang", "source"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS r, coalesce(sum(cap) OVER o, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM n WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (budget - full_before) / w_left AS level FROM f WHERE (budget - full_before) / w_left <= r ORDER BY r, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * coalesce(level, 0)) AS target FROM n CROSS JOIN l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, source, key, size, (sent + copy * source_size)::DOUBLE / target AS v FROM q, (VALUES (0), (1)) AS x(copy) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY v, key, size ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT doc_id, source, key, sum(size) AS taken FROM g WHERE run <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY doc_id, source, key)
SELECT q.doc_id, q.source, q.size, q.source_size, round(q.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.key = k.key
"""

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, coalesce(text, '')) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc, doc_id, i AS pos, lines[i] AS line, {_LOW.format(f"trim(lines[i], {_WS})")} AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10),
m AS (SELECT l.*, c.key IS NOT NULL AS gone FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""


OP6_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM tf JOIN df USING (t), g WHERE doc_id % 50 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (t) JOIN dl ON dl.doc_id = tf.doc_id, g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, rank::INTEGER AS rank, score FROM r WHERE rank <= 10
"""


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - {repeats.WINDOW - 2})) AS i FROM d),
p AS (SELECT r, i, array_to_string(w[i:i + {repeats.WINDOW - 1}], ' ') AS s FROM i),
h AS (SELECT r, i FROM p JOIN (SELECT s FROM p GROUP BY s HAVING count(*) > 1) USING (s)),
g AS (SELECT DISTINCT r, unnest(range(i, i + {repeats.WINDOW})) AS i FROM h),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def _op12_sql() -> str:
    """Each assignment ranks all entries for each part of each vector; each round takes floors of means."""
    ctes = []
    for k in range(codes.ROUNDS + 1):
        ctes.append(f"d{k} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (part, pos) GROUP BY 1, 2, 3)")
        ctes.append(f"a{k} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY 1, 2)")
        if k < codes.ROUNDS:
            ctes.append(f"m{k} AS (SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM a{k} JOIN x USING (vec_id, part) GROUP BY 1, 2, 3)")
            ctes.append(f"b{k + 1} AS (SELECT part, entry, pos, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))")
    last = codes.ROUNDS
    return f"""
WITH v AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
i AS (SELECT vec_id, r, e, unnest(range(len(e))) AS i, len(e) // {codes.PARTS} AS w FROM v),
x AS (SELECT vec_id, r, i // w AS part, i % w AS pos, floor({codes.SCALE} * e[i + 1]::DOUBLE)::BIGINT AS x FROM i),
b0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= {codes.ENTRIES}),
{", ".join(ctes)},
s AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{last}),
o AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), s
"""


OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, {_LOW.format("t")} AS t FROM (SELECT lang, source, r, unnest(w) AS t FROM d)),
k AS (SELECT lang, t, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {audit.MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, t, count(*) AS c FROM t JOIN k USING (lang, t) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
a AS (SELECT g.lang, g.source, t, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (coalesce(n.n, 0) + 5 * v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 5) // (v.n + 5 * v.v))::BIGINT AS q FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, t)),
x AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM a JOIN a AS b USING (lang, t) WHERE a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', t, p - q FROM a WHERE c > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM z)
SELECT * FROM r WHERE part = 'pair' OR rank <= {audit.TERMS}
"""


def _op2_sql() -> str:
    """Rules, models of all orders, threshold and verdicts, as in ``urls``."""
    rule, verdict = "NULL", "NULL"
    for h, p, v in sorted(urls.RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    code = " + ".join(f"{32 ** (urls.ORDER - k)} * strpos('{urls.SYMBOLS}', substr(x, i + {k}, 1))" for k in range(urls.ORDER + 1))
    ctes, p = [], {"allow": "(1.0::DOUBLE / 32)", "block": "(1.0::DOUBLE / 32)"}
    joins = ""
    for k in range(urls.ORDER + 1):
        w = 32 ** (k + 1)
        ctes.append(f"o{k} AS (SELECT gram % {w} AS g, (gram % {w}) // 32 AS c, sum(allow)::DOUBLE AS allow, sum(block)::DOUBLE AS block FROM n GROUP BY 1, 2)")
        ctes.append(f"c{k} AS (SELECT c, sum(allow) AS na, (count(*) FILTER (allow > 0))::DOUBLE AS ta, sum(block) AS nb, (count(*) FILTER (block > 0))::DOUBLE AS tb FROM o{k} GROUP BY 1)")
        joins += f" JOIN o{k} ON n.gram % {w} = o{k}.g JOIN c{k} ON o{k}.c = c{k}.c"
        for v, a in (("allow", "a"), ("block", "b")):
            p[v] = f"(CASE WHEN c{k}.n{a} > 0 THEN (o{k}.{v} + c{k}.t{a} * {p[v]}) / (c{k}.n{a} + c{k}.t{a}) ELSE {p[v]} END)"
    return f"""
WITH u AS (SELECT page_id, url, coalesce(url, '') AS s FROM pages),
h AS (SELECT *, {_LOW.format("regexp_extract(s, '://([^/?#]*)', 1)")} AS host, regexp_extract(s, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, {rule} AS rule, {verdict} AS by_rule, substr(md5(s), 1, 1) >= 'c' AS held FROM h),
d AS (SELECT DISTINCT s, by_rule, held FROM t),
x AS (SELECT s, '~~~' || translate(lower(CASE WHEN instr(s, '://') > 0 THEN substr(s, instr(s, '://') + 3) ELSE s END), '123456789', '000000000') || '~' AS x FROM d),
i AS (SELECT s, x, unnest(range(1, length(x) - {urls.ORDER} + 1)) AS i FROM x),
g AS (SELECT s, ({code})::INTEGER AS gram FROM i),
n AS (SELECT gram, count(*) FILTER (by_rule = 'allow' AND NOT held) AS allow, count(*) FILTER (by_rule = 'block' AND NOT held) AS block FROM g JOIN (SELECT s, by_rule, held FROM t) USING (s) GROUP BY gram),
{", ".join(ctes)},
m AS (SELECT n.gram, ln({p["allow"]}) - ln({p["block"]}) AS delta FROM n{joins}),
z AS (SELECT s, round(avg(delta), 9) AS score FROM g JOIN m USING (gram) GROUP BY s),
b AS (SELECT least({urls.BINS - 1}, greatest(0, floor((score + 5) / 10 * {urls.BINS}))) AS cell, count(*) FILTER (by_rule = 'allow') AS allow, count(*) FILTER (by_rule = 'block') AS block FROM d JOIN z USING (s) WHERE held AND by_rule IS NOT NULL GROUP BY 1),
e AS (SELECT cell, sum(allow) OVER (ORDER BY cell DESC) / nullif(sum(allow) OVER (), 0)::DOUBLE - sum(block) OVER (ORDER BY cell DESC) / nullif(sum(block) OVER (), 0)::DOUBLE AS gain FROM b),
k AS (SELECT (SELECT cell FROM e WHERE gain IS NOT NULL ORDER BY gain DESC, cell DESC LIMIT 1) / {urls.BINS}::DOUBLE * 10 - 5 AS threshold)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN threshold IS NULL OR score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM t JOIN z USING (s), k
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_fingerprints, op4_toxicity, op5_mixing, op6_bm25_top_k, op7_simhash, op8_line_dedup, op9_token_counts, op10_language_id, op11_substring_dedup, op12_vector_codes, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _op2_sql(), "op5_mixing": OP5_SQL, "op6_bm25_top_k": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_source_audit": OP13_SQL}
