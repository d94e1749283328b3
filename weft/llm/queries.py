"""One query for each numbered operator, over whole tables, with production parameters; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, exact_dedup, langid, packing, pii, quality, recompression, resampling, secrets, sharding, simhash, spelling, token_counts
from weft.llm.common import scratch_path
from weft.llm.spans import as_text, count_of
from weft.session import read_table, ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(ship(spark), f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(_documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_documents(spark, sf_dir).select("doc_id"), [f"shard-{i:03d}" for i in range(64)]).select("doc_id", "slot", "shard")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base"), pii.KINDS), 256).alias("base_sha256"), as_text(F.col("spans"), pii.KINDS).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(_documents(spark, sf_dir), keep_text=False)
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a ledger that is kept, so that later runs scan new blobs only, where the session names one; a new one else
    ledger = spark.conf.get("spark.weft.ledger", None) or scratch_path(spark, "ledger")
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"), ledger)
    counts = [count_of(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    spans = as_text(F.col("spans"), secrets.KINDS)
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = _tokenizer("piece_bpe_32k.model")
    fitted = langid.fit(docs.filter(~F.col("held_out")), model)
    told = langid.predict(docs, fitted, model)
    return told.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.col("sha256").alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir), drop_every=31)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read_table(spark, f"{sf_dir}/benchmark.parquet")
    return resampling.resample(_documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_bpe, op2_simhash, op3_sharding, op4_pii, op5_quality, op6_exact_dedup, op7_secrets, op8_token_counts, op9_langid, op10_packing, op11_recompression, op12_spelling, op13_resampling, pipeline]
    return {f.__name__: f for f in named}


_SPANS = r"""
  SELECT doc_id, {kind} AS kind, regexp_extract_all(text, '{pattern}', 0) AS m, {value} AS v, string_split_regex(text, '{pattern}') AS g FROM t"""

_VALUES = [
    (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "regexp_extract_all(text, '{pattern}', 1)"),
    (r"AKIA[A-Z0-9]{14,}", "NULL"),
    (r"[0-9a-f]{16,}", "NULL"),
]


#: CTEs that give the crc32 of every string in column s of the CTE named strings: crc(s, h).
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
crc_bytes AS (SELECT s, hex(encode(s)) AS x FROM strings),
crc AS (SELECT s, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h
        FROM crc_bytes, crc_table)"""


def oracle_sql() -> dict[str, str]:
    listed = " UNION ALL ".join(_SPANS.replace("{value}", v).replace("{pattern}", p).replace("{kind}", str(i)) for i, (p, v) in enumerate(_VALUES))
    secrets_sql = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS ({listed}),
rows_ AS (SELECT doc_id, kind, m, v, g, unnest(generate_series(1, len(m))) AS i FROM lists WHERE len(m) > 0),
sized AS (SELECT doc_id, kind, i, m[i] AS hit, v[i] AS val, length(g[i]) AS gap, length(m[i]) AS n FROM rows_),
placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) - n AS start FROM sized),
spans AS (SELECT doc_id, kind, start, start + n AS stop FROM placed WHERE kind > 0 OR length(val) >= 12),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)"""
    dedup_sql = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)"""
    repeats_sql = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS words FROM starts),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""
    spelling_sql = rf"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
runs AS (SELECT doc_id || ':' || translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s, count(*) AS k FROM found GROUP BY s),
strings AS (SELECT s FROM runs), {_CRC},
cut AS (SELECT substr(s, instr(s, ':') + 1) AS run, h, k FROM runs JOIN crc USING (s)),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM cut GROUP BY word HAVING length(word) >= 7 AND sum(k) >= 2),
shorter AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS best FROM near GROUP BY word),
told AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.other END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS d FROM told UNION ALL SELECT c.word, t.form, d + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told JOIN roots USING (word)"""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS s FROM {{}}" for n in (1, 2, 3))
    resampling_sql = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id AS doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
of_docs AS (SELECT doc_id, s, count(*) AS k FROM ({grams.format("d", "d", "d")}) GROUP BY doc_id, s),
of_target AS (SELECT s, count(*) AS k FROM ({grams.format("b", "b", "b")}) GROUP BY s),
strings AS (SELECT s FROM of_docs UNION SELECT s FROM of_target), {_CRC},
own AS (SELECT h % 10000 AS bucket, sum(k) AS n FROM of_docs JOIN crc USING (s) GROUP BY bucket),
target AS (SELECT h % 10000 AS bucket, sum(k) AS n FROM of_target JOIN crc USING (s) GROUP BY bucket),
all_ AS (SELECT (SELECT coalesce(sum(n), 0) FROM own)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS t),
gains AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(target.n, 0)::DOUBLE + 1) * (all_.s + 10000) / ((coalesce(own.n, 0)::DOUBLE + 1) * (all_.t + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN own USING (bucket) LEFT JOIN target USING (bucket), all_),
weights AS (SELECT doc_id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM of_docs JOIN crc USING (s) JOIN gains ON bucket = h % 10000 GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (doc_id)"""
    return {"op11_recompression": repeats_sql, "op12_spelling": spelling_sql, "op13_resampling": resampling_sql, "op6_exact_dedup": dedup_sql, "op7_secrets": secrets_sql}
