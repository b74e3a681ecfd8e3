"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, decontaminate, infilling, language, licences, mixing, neighbours, quality, resampling, simhash, suffix_dedup, toxicity, url_filter
from docloom.llm.shared import table
from docloom.llm.training import fold


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    model = language.fitted(docs.select("doc_id", "text", "lang"), ~held_out)
    found = language.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", "lang_pred", "score", "accepted").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "first_word", "n_words", "licence", "dice")


_KNOWN = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, texts in licences.TEMPLATES.items() for text in texts)
_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
OP3_SQL = rf"""
WITH template(licence, text) AS (VALUES {_KNOWN}),
known AS (
  SELECT row_number() OVER () AS k, licence, len(w) AS n, list_distinct({_PAIRS}) AS own, list_filter(list_distinct({_PAIRS}), lambda x: regexp_matches(x, '{licences.TELLING}')) AS telling, list_filter({licences.QUALIFIERS}, lambda x: NOT list_contains(w, x)) AS others
  FROM (SELECT licence, {_WORDS} AS w FROM template)),
bounded AS (SELECT *, ceil({licences.THRESHOLD} * len(own) / {2 - licences.THRESHOLD} - 1e-9) AS low, floor(len(own) * {2 - licences.THRESHOLD} / {licences.THRESHOLD} + 1e-9) AS high FROM known),
terms AS (SELECT k, unnest(own) AS pair FROM known),
docs AS (SELECT r, doc_id, {_PAIRS} AS p FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 1),
spots AS (SELECT r, unnest(range(0, len(p))) AS pos, unnest(p) AS pair FROM docs),
hits AS (SELECT r, k, pos, pair FROM spots JOIN terms USING (pair)),
enough AS (SELECT r, k FROM hits JOIN bounded USING (k) GROUP BY r, k, low HAVING count(DISTINCT pair) >= low),
windows AS (
  SELECT r, pos, least(n, len(p) + 1 - pos) AS n, licence, own, low, high, telling, others, list_distinct(p[pos + 1:pos + n - 1]) AS here
  FROM hits JOIN enough USING (r, k) JOIN bounded USING (k) JOIN docs USING (r)),
scored AS (SELECT r, pos, n, licence, 2.0::DOUBLE * len(list_intersect(here, own)) / (len(here) + len(own)) AS dice FROM windows WHERE len(here) BETWEEN low AND high AND len(list_intersect(here, telling)) = len(telling) AND NOT list_has_any(string_split(array_to_string(here, ' '), ' '), others)),
best AS (
  SELECT r, list_reduce(list([{{'pos': pos, 'n': n, 'licence': licence, 'dice': dice}}] ORDER BY dice DESC, n DESC, pos, licence),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.pos < x[1].pos + x[1].n AND x[1].pos < y.pos + y.n)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept
  FROM scored WHERE dice >= {licences.THRESHOLD} GROUP BY r)
SELECT doc_id, (x.pos + 1)::INTEGER AS first_word, x.n::INTEGER AS n_words, x.licence AS licence, x.dice AS dice FROM (SELECT r, unnest(kept) AS x FROM best) JOIN docs USING (r)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"), F.col("doc_id"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 5) == 0
    model = quality.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.scored(docs, model).select("doc.doc_id", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 3) == 1
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.scored(docs, model).select("doc.doc_id", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc.doc_id", F.size("words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
spots AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM spots),
places AS (SELECT d.doc_id, d.w, m.n, unnest(range(1, len(d.w) - m.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM known) m WHERE len(d.w) >= m.n),
met AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM places p JOIN known k ON k.n = p.n AND k.t = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page.page_id", "host", "path", "rule", "verdict")


def _term(term: str) -> str:
    return rf"(regexp_matches(lower(url), '(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)'))::INTEGER"


OP10_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
hits AS (
  SELECT *, coalesce({' + '.join(map(_term, url_filter.STRICT))}, 0) AS strict, coalesce({' + '.join(map(_term, url_filter.SOFT))}, 0) AS soft,
         {{rules}} AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({{blocks}}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict >= 1 OR soft >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM hits
"""
OP10_SQL = OP10_SQL.replace("{rules}", "CASE " + " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(url_filter.RULES, key=lambda r: -len(r[0]))) + " END").replace("{blocks}", ", ".join(f"'{r}'" for r, v in url_filter.RULES if v == "block"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sums),
rated AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM placed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM rated),
goals AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= most THEN most
              ELSE weight * coalesce(arg_min(CASE WHEN level * weight < most THEN level END, CASE WHEN level * weight < most THEN (most / weight, place) END) OVER (), 0) END AS target
  FROM levels),
runs AS (
  SELECT r.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN size * (budget // source_size) + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM runs
"""

def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = byte_bpe.of_file(public_tokenizers.path(byte_bpe.VOCABULARY))
    found = byte_bpe.encoded(table(spark, sf_dir, "documents"), known, carried=F.col("doc_id"))
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(F.col("doc").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2(byte_bpe.decoded(F.col("ids"), known), 256).alias("decoded_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.gains(docs, table(spark, sf_dir, "benchmark"))
    return resampling.ranked(resampling.scored(docs, found, F.lit(None))).withColumnRenamed("id", "doc_id")


_OWN_WORDS = r"coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), [])"
#: The table of CRC-32 is worked out from its polynomial; each different word is hashed once.
OP12_SQL = rf"""
WITH RECURSIVE steps(byte, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_OWN_WORDS} AS w FROM documents),
own AS (SELECT r, unnest(w) AS word FROM d),
aimed AS (SELECT word, count(*) AS n FROM (SELECT unnest({_OWN_WORDS}) AS word FROM benchmark) GROUP BY word),
met AS (SELECT word, count(*) AS n FROM own GROUP BY word),
known AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM met UNION SELECT word, hex(encode(word)) FROM aimed), crc_table),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM met JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM aimed JOIN known USING (word) GROUP BY bucket),
gains AS (
  SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN known USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN placed USING (r)
"""


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.infilled(table(spark, sf_dir, "documents"), carried=F.col("doc_id"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = infilling.restored(F.col("output"), F.col("form"))
    return found.select(F.col("doc").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four
  FROM d),
forms AS (
  SELECT *, least(one, two) AS low, greatest(one, two) AS high,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substr(x, 1, low) AS p, substr(x, low + 1, high - low) AS m, substr(x, high + 1) AS s FROM forms)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN low END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM parts
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_language": op2_language,
    "op3_licences": op3_licences,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_resampling": op12_resampling,
    "op13_infilling": op13_infilling,
}
SQL: dict[str, str] = {"op1_neighbours": OP1_SQL, "op3_licences": OP3_SQL, "op6_mixing": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_url_filter": OP10_SQL, "op12_resampling": OP12_SQL, "op13_infilling": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
