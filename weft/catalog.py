"""Queries on the test tables for each corpus operator, and the same in SQL.

The tables are not parallel text, so they stand in for it: a user's turn and the assistant's next turn are source and target,
documents are lines of a domain (their source), and the benchmark is one pool for all languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import languages as lang
from weft.functions import scripts
from weft.functions import text as tx
from weft.functions.punctuation import normalize_corpus, normalize_request
from weft.operators import batching, corpus, metrics, sentences, translation, vocabulary
from weft.plans import prepare
from weft.session import dealt, read_table, scratch, ship
from weft.sources import aligned, bitext, tables
from weft.sources.bitext import hypotheses
from weft.sources.bitext import vocabulary as vocabulary_lines
from weft.streaming import normalize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, lang, source, text): lines of documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitext rows: a user's turn and the assistant's next one; four pairs of languages by the conversation's number."""
    conv = dealt(table(spark, sf_dir, "conversations"), "conv_id")
    user = conv.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src_text"))
    assistant = conv.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("tgt_text"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("conv_id") % 4 + 1).cast("int"))
    both = user.join(assistant, ["conv_id", "turn"]).withColumn("src_lang", pick(["eng_Latn", "hin_Deva", "tam_Taml", "eng_Latn"])).withColumn("tgt_lang", pick(["hin_Deva", "eng_Latn", "hin_Deva", "urd_Arab"]))
    return both.select(F.concat_ws("-", "src_lang", "tgt_lang").alias("pair"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "src_lang", "tgt_lang", F.coalesce("src_text", F.lit("")).alias("src_text"), F.coalesce("tgt_text", F.lit("")).alias("tgt_text"))


TURNS = """turns AS (
  SELECT src_lang || '-' || tgt_lang AS pair, line_no, src_lang, tgt_lang, src_text, tgt_text FROM (
    SELECT u.conv_id * 1000 + a.turn AS line_no, ['eng_Latn', 'hin_Deva', 'tam_Taml', 'eng_Latn'][u.conv_id % 4 + 1] AS src_lang,
           ['hin_Deva', 'eng_Latn', 'hin_Deva', 'urd_Arab'][u.conv_id % 4 + 1] AS tgt_lang, coalesce(u.text, '') AS src_text, coalesce(a.text, '') AS tgt_text
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'))"""
LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
SENTENCES = r"""sentences AS (
  SELECT doc_id, lang, unnest(generate_series(0, len(s) - 1)) AS sentence_no, unnest(s) AS text FROM (
    SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
  WHERE len(s) > 0)"""
BENCH = r"""bench AS (
  SELECT DISTINCT unnest(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS text FROM benchmark)"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def loose_sql(x: str) -> str:
    squeezed = strip_sql(f"replace(regexp_replace({x}, ' +', ' ', 'g'), chr(10), '')")
    return rf"lower(regexp_replace(regexp_replace({squeezed}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', '', 'g'), ' +', ' ', 'g'))"


def strict_sql(x: str) -> str:
    gone = tx.PUNCTUATION.replace("'", "''")
    return f"translate(lower(replace({x}, ' ', '')), '{gone}', '')"


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(tx.sentences(F.coalesce("text", F.lit("")))).alias("sentence_no", "text"))


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(tx.sentences(F.coalesce("text", F.lit("")))).alias("text")).distinct()


# Decontamination and distinct


@query(f"""WITH {SENTENCES}, {BENCH}, keys AS (SELECT DISTINCT {loose_sql("text")} AS k FROM bench)
SELECT lang, count(*) AS total, count(*) FILTER (k IS NULL) AS kept, count(*) FILTER (k IS NOT NULL) AS removed
FROM sentences LEFT JOIN keys ON {loose_sql("text")} = k GROUP BY lang""")
def decontam_loose_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences a language, and how many of them the benchmark has."""
    rows, pool = sentence_rows(spark, sf_dir), bench_rows(spark, sf_dir).select(tx.loose_key(F.col("text")))
    told = corpus.flagged(rows, [tx.loose_key(F.col("text"))], pool, "held")
    return told.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(~F.col("held")).alias("kept"), F.count_if("held").alias("removed"))


@query(f"""WITH {LINES}, keys AS (SELECT DISTINCT {loose_sql("t")} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark) WHERE {strip_sql("t")} <> '')
SELECT doc_id, line_no::INT AS line_no, text FROM lines WHERE {loose_sql("text")} NOT IN (SELECT k FROM keys)""")
def decontam_loose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n", -1)).alias("text")).filter(tx.strip(F.col("text")) != "").select(tx.loose_key(F.col("text")))
    return corpus.anti_join_any(lines(spark, sf_dir), [([tx.loose_key(F.col("text"))], pool)]).select("doc_id", "line_no", "text")


@query(f"""WITH {TURNS}, held AS (SELECT * FROM turns WHERE line_no % 7 < 2 AND pair IN (SELECT pair FROM turns GROUP BY pair HAVING count(*) FILTER (line_no % 7 = 0) > 0 AND count(*) FILTER (line_no % 7 = 1) > 0)),
s AS (SELECT DISTINCT {strict_sql("src_text")} AS k FROM held), t AS (SELECT DISTINCT pair, {strict_sql("tgt_text")} AS k FROM held)
SELECT line_no, x.pair, src_text, tgt_text FROM turns x WHERE line_no % 7 >= 2 AND {strict_sql("src_text")} NOT IN (SELECT k FROM s)
AND NOT EXISTS (SELECT 1 FROM t WHERE t.pair = x.pair AND t.k = {strict_sql("x.tgt_text")})""")
def decontam_strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of seven rows one is held out for dev and one for test; the rest must not have the keys of pairs that have both."""
    rows = turns(spark, sf_dir)
    held = rows.filter("line_no % 7 < 2").withColumn("benchmark", F.lit("held")).withColumn("split", F.when(F.col("line_no") % 7 == 0, "dev").otherwise("test"))
    return corpus.decontaminate_strict(rows.filter("line_no % 7 >= 2"), held.select("benchmark", "pair", "split", "src_text", "tgt_text")).select("line_no", "pair", "src_text", "tgt_text")


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, text): the benchmark's lines, dealt to the languages of the turns by their lengths."""
    codes = F.array(*(F.lit(c) for c in ("eng_Latn", "hin_Deva", "tam_Taml", "urd_Arab")))
    lines_ = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("text"))
    return lines_.select(F.get(codes, (F.length("text") % 4).cast("int")).alias("lang"), "text")


def _turns_with_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, and each benchmark line as a source and, with its blanks doubled, as a target beside a text of its own."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))
    at = F.lit(-1) - (F.col("item_id") * 1000 + F.col("i")) * 2
    pair = lambda s, t: [F.lit(f"{s}-{t}").alias("pair"), F.lit(s).alias("src_lang"), F.lit(t).alias("tgt_lang")]
    own = F.concat(F.lit("line "), at.cast("string"))
    first = bench.select(*pair("eng_Latn", "hin_Deva"), at.alias("line_no"), F.concat("text", F.lit(" !")).alias("src_text"), own.alias("tgt_text"))
    second = bench.select(*pair("tam_Taml", "urd_Arab"), (at - 1).alias("line_no"), own.alias("src_text"), F.replace("text", F.lit(" "), F.lit("  ")).alias("tgt_text"))
    rows = turns(spark, sf_dir).select(first.columns)
    return rows.unionByName(first).unionByName(second)


_WITH_BENCH = """b AS (SELECT item_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS text FROM (SELECT item_id, string_split(coalesce(text, ''), chr(10)) AS l FROM benchmark)),
more AS (SELECT pair, src_lang, tgt_lang, line_no, src_text, tgt_text FROM turns
  UNION ALL SELECT 'eng_Latn-hin_Deva', 'eng_Latn', 'hin_Deva', -1 - (item_id * 1000 + i) * 2, text || ' !', 'line ' || (-1 - (item_id * 1000 + i) * 2) FROM b
  UNION ALL SELECT 'tam_Taml-urd_Arab', 'tam_Taml', 'urd_Arab', -2 - (item_id * 1000 + i) * 2, 'line ' || (-1 - (item_id * 1000 + i) * 2), replace(text, ' ', '  ') FROM b)"""


def squeeze_sql(x: str) -> str:
    return strip_sql(f"replace(regexp_replace({x}, ' +', ' ', 'g'), chr(10), '')")


@query(f"""WITH {TURNS}, {_WITH_BENCH}, keys AS (SELECT DISTINCT ['eng_Latn', 'hin_Deva', 'tam_Taml', 'urd_Arab'][length(text) % 4 + 1] AS lang, {loose_sql("text")} AS k FROM b WHERE {strip_sql("text")} <> '')
SELECT line_no, pair, {squeeze_sql("src_text")} AS src_text, {squeeze_sql("tgt_text")} AS tgt_text FROM more m
WHERE NOT EXISTS (SELECT 1 FROM keys WHERE lang = m.src_lang AND k = {loose_sql("m.src_text")}) AND NOT EXISTS (SELECT 1 FROM keys WHERE lang = m.tgt_lang AND k = {loose_sql("m.tgt_text")})""")
def decontam_loose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each turn, and of pairs made of benchmark lines, against the benchmark of their own languages."""
    return corpus.decontaminate_loose(_turns_with_bench(spark, sf_dir), _by_lang(spark, sf_dir)).select("line_no", "pair", "src_text", "tgt_text")


@query(f"""WITH {TURNS} SELECT pair, min(line_no) AS line_no, src_text, tgt_text FROM turns GROUP BY pair, src_text, tgt_text""")
def pair_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_pairs(turns(spark, sf_dir).select("pair", "line_no", "src_text", "tgt_text"))


@query(f"""WITH {LINES} SELECT DISTINCT lang, {strip_sql("text")} AS text FROM lines""")
def merge_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of all domains (sources), each line of a language once."""
    rows = lines(spark, sf_dir).select("lang", "source", tx.strip(F.col("text")).alias("text"))
    return corpus.union_distinct([rows.filter("source < 'src5'"), rows.filter("source >= 'src5' or source is null")], ["lang", "text"]).select("lang", "text")


@query(f"""WITH {LINES}, p AS (SELECT {strip_sql("text")} AS k, source, doc_id * 100000 + line_no AS pos FROM lines WHERE {strip_sql("text")} <> ''),
a AS (SELECT k, max(pos) AS src FROM p WHERE source IN ('src0', 'src1', 'src2') GROUP BY k)
SELECT DISTINCT src::VARCHAR AS src_text, p.pos::VARCHAR AS tgt_text FROM p JOIN a USING (k) WHERE coalesce(source, '') NOT IN ('src0', 'src1', 'src2')""")
def pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources as one language and all others, none or null too, as another over equal lines."""
    rows = lines(spark, sf_dir).withColumn("at", F.col("doc_id") * 100000 + F.col("line_no")).filter(tx.strip(F.col("text")) != "")
    first = F.coalesce("source", F.lit("")).isin("src0", "src1", "src2")
    side = lambda which: rows.filter(which).select(F.col("text").alias("pivot_text"), F.col("at").cast("string").alias("text"), F.col("at").alias("line_no"))
    return corpus.pivot_join(side(first), side(~first))


@query(f"""WITH {LINES}, p AS (SELECT {strip_sql("text")} AS k, md5(coalesce(source, '')) < '8' AS one, doc_id * 100000 + line_no AS pos FROM lines WHERE {strip_sql("text")} <> ''),
a AS (SELECT k, max(pos) AS src FROM p WHERE one GROUP BY k)
SELECT DISTINCT src::VARCHAR AS src_text, p.pos::VARCHAR AS tgt_text FROM p JOIN a USING (k) WHERE NOT one""")
def pivot_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, none or null too, dealt to two languages by a hash, over equal lines."""
    rows = lines(spark, sf_dir).withColumn("at", F.col("doc_id") * 100000 + F.col("line_no")).filter(tx.strip(F.col("text")) != "")
    one = F.md5(F.coalesce("source", F.lit("")).cast("binary")) < "8"
    side = lambda which: rows.filter(which).select(F.col("text").alias("pivot_text"), F.col("at").cast("string").alias("text"), F.col("at").alias("line_no"))
    return corpus.pivot_join(side(one), side(~one))


# Filters and counts

_SIZE = f"len(string_split({strip_sql('{x}')}, ' '))"


def _pieces(x: str) -> str:
    return _SIZE.replace("{x}", x)


@query(f"""WITH {TURNS} SELECT line_no, pair FROM turns WHERE {_pieces("src_text")} <= 40 AND {_pieces("tgt_text")} <= 40""")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_filter(turns(spark, sf_dir), 40).select("line_no", "pair")


@query(f"""SELECT count(*) AS total, count(*) FILTER ({_pieces("coalesce(text, '')")} > 200) AS dropped FROM documents""")
def length_filter_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.size(tx.pieces_of(F.coalesce("text", F.lit("")))).alias("n"))
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 200).alias("dropped"))


@query(f"""WITH {TURNS} SELECT src_lang, tgt_lang, count(*) AS cnt FROM turns GROUP BY src_lang, tgt_lang""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pair_stats(turns(spark, sf_dir))


@query(f"""WITH {TURNS}, s AS (SELECT src_lang, tgt_lang, count(*) AS cnt FROM turns GROUP BY src_lang, tgt_lang)
SELECT * FROM s UNION ALL SELECT tgt_lang, src_lang, cnt FROM s WHERE src_lang <> tgt_lang""")
def pair_stats_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mirrored(corpus.pair_stats(turns(spark, sf_dir)))


@query(f"""WITH {TURNS}, s AS (SELECT src_lang, tgt_lang, count(*) AS cnt FROM turns GROUP BY src_lang, tgt_lang)
SELECT *, coalesce(sum(cnt) OVER (ORDER BY src_lang, tgt_lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s""")
def pair_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.offsets(corpus.pair_stats(turns(spark, sf_dir)))


@query(f"""WITH {TURNS} SELECT src_lang, tgt_lang FROM turns""")
def metadata_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.expand_runs(corpus.pair_stats(turns(spark, sf_dir)))


@query(f"""WITH {TURNS} SELECT pair, count(*) - count(DISTINCT (src_text, tgt_text)) AS removed FROM turns GROUP BY pair""")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("pair", "src_text", "tgt_text").agg(F.count("*").alias("n")).groupBy("pair").agg((F.sum("n") - F.count("*")).alias("removed"))


@query(f"""WITH {TURNS} SELECT pair, (row_number() OVER (PARTITION BY pair ORDER BY line_no) - 1)::BIGINT AS n,
((row_number() OVER (PARTITION BY pair ORDER BY line_no) - 1) // 128)::BIGINT AS batch, line_no FROM turns""")
def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("n", F.col("line_no"))
    return corpus.batches(corpus.renumber(rows, order="n"), 128, order="n").select("pair", "n", "batch", "line_no")


@query("SELECT a.lang AS l1, b.lang AS l2 FROM (SELECT DISTINCT lang FROM documents) a JOIN (SELECT DISTINCT lang FROM documents) b ON a.lang < b.lang")
def language_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.language_pairs(table(spark, sf_dir, "documents").select("lang").distinct())


# Languages


def values_sql(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") AS d({names})"


@query(f"""WITH {TURNS} SELECT line_no, src_lang || ' ' || tgt_lang || ' ' || {strip_sql("src_text")} AS src_text FROM turns""")
def lang_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.add_tags(turns(spark, sf_dir)).select("line_no", "src_text")


@query(f"""WITH {TURNS} SELECT line_no, a.iso AS src_iso, b.proc AS tgt_proc FROM turns JOIN (SELECT * FROM {values_sql(lang.language_rows(), "flores, proc, iso")}) a ON a.flores = src_lang
JOIN (SELECT * FROM {values_sql(lang.language_rows(), "flores, proc, iso")}) b ON b.flores = tgt_lang""")
def lang_code_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = lang.language_dim(spark)
    src, tgt = dim.select(F.col("flores").alias("src_lang"), F.col("iso").alias("src_iso")), dim.select(F.col("flores").alias("tgt_lang"), F.col("proc_code").alias("tgt_proc"))
    return turns(spark, sf_dir).join(F.broadcast(src), "src_lang").join(F.broadcast(tgt), "tgt_lang").select("line_no", "src_iso", "tgt_proc")  # 32 rows


@query(f"""WITH d AS (SELECT * FROM {values_sql(lang.punctuation_rows(), "code, kind")}), c AS (SELECT DISTINCT code FROM (
SELECT flores AS code FROM {values_sql(lang.language_rows(), "flores, proc, iso")} UNION ALL SELECT lang || '_Latn' FROM documents))
SELECT c.code, coalesce(d.kind, n.kind, 'en') AS punct_lang FROM c LEFT JOIN d ON d.code = c.code
LEFT JOIN (SELECT left(code, 3) AS p, arg_min(kind, code) AS kind FROM d GROUP BY 1) n ON n.p = left(c.code, 3)""")
def punct_lang_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("_Latn")).alias("code"))
    return lang.punctuation_language(lang.language_dim(spark).select(F.col("flores").alias("code")).union(own).filter("code is not null").distinct()).select("code", "punct_lang")


_CODES = [a for a, _ in lang.iso_rows()] + ["zz"]
_ISO = ", ".join(f"'{a}'" for a in _CODES)


@query(f"""WITH {TURNS}, i AS (SELECT line_no, [{_ISO}] AS c FROM turns), p AS (SELECT line_no, c[line_no % {len(_CODES)} + 1] AS src, c[line_no // 1000 % {len(_CODES)} + 1] AS tgt FROM i), k AS (SELECT unnest([{_ISO}]) AS c EXCEPT SELECT 'zz')
SELECT line_no, src, tgt, CASE WHEN src = 'en' AND tgt IN (FROM k) THEN 'en-indic' WHEN src IN (FROM k) AND tgt = 'en' THEN 'indic-en' WHEN src IN (FROM k) AND tgt IN (FROM k) THEN 'indic-indic' END AS direction FROM p""")
def route_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for each turn; its number tells the languages that it is taken to be in."""
    codes, n = F.array(*map(F.lit, _CODES)), F.col("line_no")
    asked = turns(spark, sf_dir).select("line_no", F.get(codes, n % len(_CODES)).alias("src"), F.get(codes, F.floor(n / 1000) % len(_CODES)).alias("tgt"))
    return asked.withColumn("direction", lang.direction(F.col("src"), F.col("tgt")))


@query(f"""WITH {TURNS}, d AS (SELECT * FROM {values_sql(lang.system_rows(), "system, flores, code")})
SELECT a.system, pair, a.code AS src_code, b.code AS tgt_code, count(*) AS n FROM turns JOIN d a ON a.flores = src_lang JOIN d b ON b.flores = tgt_lang AND a.system = b.system GROUP BY ALL""")
def supported_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.supported(turns(spark, sf_dir), lang.system_dim(spark)).groupBy("system", "pair", "src_code", "tgt_code").agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS} SELECT DISTINCT src_lang AS code, split_part(src_lang, '_', 2) NOT IN ('Arab', 'Aran', 'Olck', 'Mtei', 'Latn') AS needs FROM turns""")
def script_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.col("src_lang").alias("code"), lang.needs_transliteration(F.col("src_lang")).alias("needs")).distinct()


# Text functions on the documents' lines; digits and quotes are mixed in, as the tables hold none of the rarer ones.

_MIXED = "text || ' ९५ % ౧ “a” ‘b’ d’e (x) , «y» 3 4… ' || lang"


def _mixed() -> Column:
    return F.concat("text", F.lit(" ९५ % ౧ “a” ‘b’ d’e (x) , «y» 3 4… "), F.coalesce("lang", F.lit("")))


def on_lines(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: lines(spark, sf_dir).select("doc_id", "line_no", f(_mixed()).alias("out"))


def lines_sql(expression: str) -> str:
    return f"WITH {LINES}, m AS (SELECT doc_id, line_no::INT AS line_no, {_MIXED.replace('lang', "coalesce(lang, '')")} AS x FROM lines) SELECT doc_id, line_no, {expression} AS out FROM m"


def listed_sql(pattern: str) -> str:
    """All matches in x, written as Spark writes an array; classes by Unicode, as the engine of the SQL has them in ASCII only."""
    own = pattern.replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Pc}]").replace("'", "''")
    return f"'[' || array_to_string(regexp_extract_all(x, '{own}', 0), ', ') || ']'"


def replaced_sql(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {a}, {b})"
    return x


_NB, _Q, _QQ = "chr(160)", "chr(39)", "chr(34)"


def subbed_sql(x: str, *pairs: tuple[str, str]) -> str:
    for what, by in pairs:
        x = f"regexp_replace({x}, '{what}', '{by}', 'g')"
    return x


def _marks_sql(x: str) -> str:
    """Guillemets and no-break spaces, which both conventions treat alike."""
    x = replaced_sql(x, (f"{_NB} || chr(171) || {_NB}", f"' ' || {_QQ}"), (f"chr(171) || {_NB}", _QQ), ("chr(171)", _QQ), (f"{_NB} || chr(187) || {_NB}", f"{_QQ} || ' '"), (f"{_NB} || chr(187)", _QQ), ("chr(187)", _QQ))
    return replaced_sql(x, (f"{_NB} || '%'", "'%'"), (f"'n' || chr(186) || {_NB}", "'n' || chr(186) || ' '"), (f"{_NB} || ':'", "':'"), (f"{_NB} || chr(186) || 'C'", "' ' || chr(186) || 'C'"), (f"{_NB} || 'cm'", "' cm'"), *((f"{_NB} || '{c}'", f"'{c}'") for c in "?!;"), (f"',' || {_NB}", "', '"))


def _request_sql() -> str:
    """The rules for requests, written for SQL on their own: brackets, marks, quotes, dashes, guillemets, no-break spaces, runs, digits of any script."""
    x = replaced_sql("x", ("chr(13)", "''"), ("'('", "' ('"), ("')'", "') '"), ("'( '", "'('"), ("' )'", "')'"), ("' :'", "':'"), ("' ;'", "';'"), ("chr(96)", _Q))
    x = replaced_sql(x, *((f"chr({c})", _QQ) for c in (0x201E, 0x201C, 0x201D)), ("chr(8211)", "'-'"), ("chr(8212)", "' - '"), *((f"chr({c})", _Q) for c in (0xB4, 0x2018, 0x201A, 0x2019)), (f"{_Q} || {_Q}", _QQ), ("chr(8230)", "'...'"))
    x = subbed_sql(_marks_sql(x), (" {2,}", " "), (r"\.{2,}", "."), (r"\) ([.!:?;,])", r")\1"), (r"(\p{Nd}) %", r"\1%"), (r'"([,.]+)', r'\1"'), ("(\\p{Nd})\u00a0(\\p{Nd})", r"\1.\2"))
    return f"trim({x}, ' ')"


def corpus_sql(x: str, lang_: str) -> str:
    """The rules for corpora, written for SQL on their own; a line feed stands at the text's end meanwhile."""
    x = subbed_sql(replaced_sql(f"({x} || chr(10))", ("chr(13)", "''"), ("'('", "' ('"), ("')'", "') '")), (" +", " "), (r"\) ([.!:?;,])", r")\1"))
    x = subbed_sql(replaced_sql(x, ("'( '", "'('"), ("' )'", "')'")), ("([0-9]) %", r"\1%"))
    x = replaced_sql(x, ("' :'", "':'"), ("' ;'", "';'"), ("chr(96)", _Q), (f"{_Q} || {_Q}", f"' ' || {_QQ} || ' '"), *((f"chr({c})", _QQ) for c in (0x201E, 0x201C, 0x201D)), ("chr(8211)", "'-'"), ("chr(8212)", "' - '"))
    x = replaced_sql(subbed_sql(x, (" +", " ")), ("chr(180)", _Q))
    x = subbed_sql(x, ("([A-Za-z])\u2018([A-Za-z])", "\\1''\\2"), ("([A-Za-z])\u2019([A-Za-z])", "\\1''\\2"))
    x = replaced_sql(x, ("chr(8216)", _Q), ("chr(8218)", _Q), ("chr(8217)", _QQ), (f"{_Q} || {_Q}", _QQ), ("chr(8230)", "'...'"))
    x = subbed_sql(_marks_sql(x), (" +", " "))
    x = subbed_sql(x, (r'"([,.]+)', r'\1"')) if lang_ == "en" else subbed_sql(replaced_sql(x, (f"',' || {_QQ}", f"{_QQ} || ','")), (r'(\.+)"([ \t\n\x0b\f\r]*[^<])', r'"\1\2'))
    return subbed_sql(x, ("([0-9])\u00a0([0-9])", r"\1.\2"), (r"\n$", ""))


_REQUEST_SQL = _request_sql()

# Entities in SQL, whose patterns know no look-around: a URL starts after what is neither a word's character nor a slash or dot, takes
# all characters that it may hold, and gives back those at its end that are in no word.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_URL_SQL = rf"""list_filter(list_transform(regexp_extract_all({{x}}, '(?:^|[^{_W}/.])((?:(?:https?|ftp)://[{_W}-]+|[{_W}][{_W}-]*)\.[{_W}/\-?#&=%][{_W}/\-?#&=%.]*)', 1), lambda u: regexp_replace(u, '[^{_W}]+$', '')),
 lambda u: regexp_matches(u, '^(?:(?:https?|ftp)://)?[{_W}-]+\.[{_W}/\-?#&=%]'))"""


def found_sql(x: str, name: str) -> str:
    """The matches of an entity pattern in x, as a list."""
    if name == "url":
        return _URL_SQL.replace("{x}", x)
    own = tx.ENTITIES[name].replace(r"\d", r"\p{Nd}").replace(r"\w", f"[{_W}]").replace(r"\s", r"[\s\x{85}\p{Z}]").replace("'", "''")
    return f"regexp_extract_all({x}, '{own}', 0)"


def once_sql(found: str) -> str:
    return f"list_filter({found}, lambda m, i: list_position({found}, m) = i)"


_SPACES = r"[\s\x{85}\p{Z}]+"
_DIGITS = f"translate({{x}}, '{tx.DIGITS_FROM}', '{tx.DIGITS_TO}')"


def _wrapped_sql(x: str, found: str) -> str:
    return f"regexp_replace(list_reduce({found}, lambda a, m: replace(a, m, ' <dnt> ' || m || ' </dnt> '), {x}), '{_SPACES}', ' ', 'g')"


def wrap_steps_sql(source: str, keys: str) -> str:
    """CTEs w0 to w4 over source (keys, x): digits, then each kind of entity tagged in turn; x of w4 is the result."""
    ctes = [f"w0 AS (SELECT {keys}, {_DIGITS.replace('{x}', 'x')} AS x FROM {source})"]
    for i, name in enumerate(tx.ENTITIES):
        ctes.append(f"f{i} AS (SELECT {keys}, x, {found_sql('x', name)} AS f FROM w{i}), w{i + 1} AS (SELECT {keys}, {_wrapped_sql('x', once_sql('f'))} AS x FROM f{i})")
    return ", ".join(ctes)


def placeholder_steps_sql(source: str, keys: str) -> str:
    """CTEs over source (keys, x); p has keys, text with placeholders and e, the list of entities."""
    ctes = [f"p0 AS (SELECT {keys}, {{'t': {_DIGITS.replace('{x}', 'x')}, 'e': []::VARCHAR[]}} AS s FROM {source})"]
    for i, name in enumerate(tx.ENTITIES):
        keep = {"url": "length(replace(m, '.', '')) >= 4", "numeral": "length(translate(m, ' .:', '')) >= 4"}.get(name, "true")
        step = "lambda a, m: {'t': replace(a.t, m.t, '<ID' || (len(a.e) + 1) || '>'), 'e': list_append(a.e, m.t)}"
        ctes.append(f"q{i} AS (SELECT {keys}, s, {found_sql('s.t', name)} AS f FROM p{i})")
        ctes.append(f"r{i} AS (SELECT {keys}, s, list_filter({once_sql('f')}, lambda m: {keep}) AS f FROM q{i})")
        ctes.append(f"p{i + 1} AS (SELECT {keys}, list_reduce(list_prepend(s, list_transform(f, lambda m: {{'t': m, 'e': []::VARCHAR[]}})), {step}) AS s FROM r{i})")
    ctes.append(f"p AS (SELECT {keys}, {strip_sql(f"replace(regexp_replace(s.t, '{_SPACES}', ' ', 'g'), '>/', '>')")} AS text, s.e AS e FROM p{len(tx.ENTITIES)})")
    return ", ".join(ctes)


_RESTORED = """list_reduce(list_prepend({'t': {x}, 'n': 0::BIGINT}, list_transform(e, lambda m, i: {'t': m, 'n': i})),
 lambda a, m: {'t': replace(replace(a.t, '<ID' || m.n || '>', m.t), '< ID' || m.n || ' >', m.t), 'n': m.n}).t"""
_UNWRAPPED = lambda x: strip_sql(f"regexp_replace(replace({strip_sql(f"regexp_replace(replace({x}, '<dnt>', ' '), '{_SPACES}', ' ', 'g')")}, '</dnt>', ' '), '{_SPACES}', ' ', 'g')")
_M = lines_sql("x").split(" SELECT doc_id, line_no, x AS out")[0]


def _text_queries() -> None:
    for name, f, sql in (
        ("digit_normalize", tx.ascii_digits, f"translate(x, '{tx.DIGITS_FROM}', '{tx.DIGITS_TO}')"),
        ("punct_corpus_en", lambda c: normalize_corpus(c, "en"), corpus_sql("x", "en")),
        ("punct_corpus_other", lambda c: normalize_corpus(c, "hi"), corpus_sql("x", "hi")),
        ("punct_request", normalize_request, _REQUEST_SQL),
        ("output_clean", tx.clean_output, strip_sql(r"regexp_replace(x, '\s+', ' ', 'g')")),
        ("output_one_line", tx.one_line, strip_sql("replace(x, chr(10), '')")),
        ("piece_join", tx.join_pieces, strip_sql("replace(replace(x, ' ', ''), '▁', ' ')")),
        ("key_loose", tx.loose_key, loose_sql("x")),
        ("key_strict", tx.strict_key, strict_sql("x")),
        ("entities_email", lambda c: tx.matches(c, tx.EMAIL).cast("string"), listed_sql(tx.EMAIL)),
        ("entities_url", lambda c: tx.matches(c, tx.URL).cast("string"), f"'[' || array_to_string({found_sql('x', 'url')}, ', ') || ']'"),
        ("entities_numeral", lambda c: tx.matches(c, tx.NUMERAL).cast("string"), listed_sql(tx.NUMERAL)),
        ("entities_other", lambda c: tx.matches(c, tx.OTHER).cast("string"), listed_sql(tx.OTHER)),
        ("dnt_wrap", tx.wrap, None),
        ("dnt_unwrap", lambda c: tx.unwrap(tx.wrap(c)), None),
        ("placeholder_wrap", lambda c: tx.placeholders(c)["text"], None),
        ("placeholder_roundtrip", lambda c: tx.let(tx.placeholders(c), lambda s: tx.restore(s["text"], s["entities"])), None),
    ):
        QUERIES[name] = on_lines(f)
        if sql is not None:
            SQL[name] = lines_sql(sql)
    keys = "doc_id, line_no"
    SQL["dnt_wrap"] = f"{_M}, {wrap_steps_sql('m', keys)} SELECT {keys}, {strip_sql('x')} AS out FROM w4"
    SQL["dnt_unwrap"] = f"{_M}, {wrap_steps_sql('m', keys)} SELECT {keys}, {_UNWRAPPED(strip_sql('x'))} AS out FROM w4"
    SQL["placeholder_wrap"] = f"{_M}, {placeholder_steps_sql('m', keys)} SELECT {keys}, text AS out FROM p"
    SQL["placeholder_roundtrip"] = f"{_M}, {placeholder_steps_sql('m', keys)} SELECT {keys}, {_RESTORED.replace('{x}', 'text')} AS out FROM p"


_text_queries()


def wrap_pair_steps_sql(source: str, keys: str) -> str:
    """CTEs w0 to w4 over source (keys, x, y): the entities that both sides hold tagged in both."""
    ctes = [f"w0 AS (SELECT {keys}, {_DIGITS.replace('{x}', 'x')} AS x, {_DIGITS.replace('{x}', 'y')} AS y FROM {source})"]
    for i, name in enumerate(tx.ENTITIES):
        ctes.append(f"f{i} AS (SELECT {keys}, x, y, {found_sql('x', name)} AS f, {found_sql('y', name)} AS g FROM w{i})")
        ctes.append(f"g{i} AS (SELECT {keys}, x, y, list_filter({once_sql('f')}, lambda m: list_contains(g, m)) AS f FROM f{i})")
        ctes.append(f"w{i + 1} AS (SELECT {keys}, {_wrapped_sql('x', 'f')} AS x, {_wrapped_sql('y', 'f')} AS y FROM g{i})")
    return ", ".join(ctes)


@query(f"""WITH {TURNS}, t AS (SELECT line_no, src_text AS x, tgt_text AS y FROM turns), {wrap_pair_steps_sql("t", "line_no")} SELECT line_no, x AS src_text, y AS tgt_text FROM w4""")
def dnt_wrap_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("line_no", tx.wrap_common(F.col("src_text"), F.col("tgt_text")).alias("w"))
    return rows.select("line_no", F.col("w.src").alias("src_text"), F.col("w.tgt").alias("tgt_text"))


# Segmentation, translation with a stand-in, reassembly


@query(f"WITH {SENTENCES} SELECT doc_id, sentence_no::INT AS sentence_no, text FROM sentences")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir).select("doc_id", "sentence_no", "text")


@query(r"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)
SELECT doc_id, i::INT AS chunk_no, array_to_string(w[i * 256 + 1 : i * 256 + 256], ' ') AS text FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(ceil(len(w) / 256)::INT - 1, 0))) AS i FROM w)""")
def chunk_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks(F.split(F.coalesce("text", F.lit("")), " ", -1))).alias("chunk_no", "words"))
    return docs.select("doc_id", "chunk_no", F.array_join("words", " ").alias("text"))


@query(f"""WITH {SENTENCES}, words AS (SELECT doc_id, sentence_no, string_split(text, ' ') AS w FROM sentences),
parts AS (SELECT doc_id, sentence_no, i AS chunk_no, array_to_string(w[i * 256 + 1 : i * 256 + 256], ' ') AS x FROM (SELECT *, unnest(generate_series(0, greatest(ceil(len(w) / 256)::INT - 1, 0))) AS i FROM words)),
{placeholder_steps_sql("parts", "doc_id, sentence_no, chunk_no")}, done AS (SELECT doc_id, string_agg({_RESTORED.replace("{x}", "'hi: ' || text")}, ' ' ORDER BY sentence_no, chunk_no) AS text FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(done.text, '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN done USING (doc_id)""")
def translate_paragraphs_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("en").alias("src"), F.lit("hi").alias("tgt"), F.coalesce("text", F.lit("")).alias("text"))
    return translation.translate_paragraphs(docs, translation.echo, ["doc_id"])


@query(f"""WITH {TURNS} SELECT line_no, CASE WHEN src_lang = 'tam_Taml' THEN 'hi: en: ' WHEN tgt_lang = 'eng_Latn' THEN 'en: ' WHEN tgt_lang = 'hin_Deva' THEN 'hi: ' ELSE 'ur: ' END || src_text AS text FROM turns""")
def pivot_two_hop_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    dim = lang.language_dim(spark).select("flores", "iso")
    rows = turns(spark, sf_dir).join(F.broadcast(dim.toDF("src_lang", "src")), "src_lang").join(F.broadcast(dim.toDF("tgt_lang", "tgt")), "tgt_lang")  # 32 rows
    return translation.translate_routed(rows.select("line_no", "src", "tgt", F.col("src_text").alias("text")), translation.echo, ["en-indic", "indic-en"]).select("line_no", "text")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder's log made of the conversations: hypotheses among other lines."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 100 + F.col("turn"))
    tag = F.when(F.col("role") == "assistant", "H-").otherwise("S-")
    return rows.select(F.col("at").alias("line_no"), F.concat(tag, (F.col("conv_id") * 2).cast("string"), F.lit("\t-"), (F.col("turn") / 8).cast("string"), F.lit("\t"), F.regexp_replace("text", "[\t\n]", " ")).alias("text"))


_LAST = "(SELECT conv_id * 2 AS id, arg_max(regexp_replace(text, '[\\t\\n]', ' ', 'g'), turn) AS hyp FROM conversations WHERE role = 'assistant' GROUP BY 1)"


@query("SELECT (conv_id * 2)::INT AS id, -turn / 8 AS score, regexp_replace(text, '[\\t\\n]', ' ', 'g') AS hyp FROM conversations WHERE role = 'assistant'")
def hyp_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses(_log(spark, sf_dir)).select("id", "score", "hyp")


@query(f"WITH n AS (SELECT max(conv_id) AS n FROM conversations) SELECT i::INT AS id, coalesce(hyp, '') AS hyp FROM (SELECT unnest(generate_series(0, (SELECT n * 2 + 1 FROM n))) AS i) LEFT JOIN {_LAST} h ON h.id = i")
def hyp_left_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0]
    ids = spark.range(0 if most is None else most * 2 + 2).select(F.col("id").cast("int").alias("id"))
    return translation.fill_missing(ids, hypotheses(_log(spark, sf_dir)))


@query("""SELECT (conv_id * 2)::INT AS id, -turn / 8 AS score, regexp_replace(text, '[\\t\\n]', ' ', 'g') AS hyp FROM conversations WHERE role = 'assistant'
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY -turn DESC, text) <= 2""")
def hyp_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.best_hypotheses(hypotheses(_log(spark, sf_dir)), 2).select("id", "score", "hyp")


# Vocabulary

_TOKENS = f"WITH {LINES}, t AS (SELECT token, count(*) AS freq FROM (SELECT unnest(string_split({strip_sql('text')}, ' ')) AS token FROM lines) WHERE token <> '' GROUP BY token)"


@query(f"{_TOKENS} SELECT token, freq FROM t")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.token_counts(lines(spark, sf_dir))


@query(f"{_TOKENS} SELECT token, freq, (row_number() OVER (ORDER BY freq DESC, token) + 3)::INT AS id FROM t WHERE freq >= 5")
def vocab_threshold5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.numbered(vocabulary.token_counts(lines(spark, sf_dir)))


@query(f"""WITH {LINES}, a AS (SELECT text FROM lines UNION ALL SELECT concat_ws(' ', source, line_no) FROM lines),
s AS (SELECT string_split(regexp_replace(text, '^[\\r\\n ]+|[\\r\\n ]+$', '', 'g'), ' ') AS p FROM a)
SELECT p[1] AS token, CASE WHEN regexp_matches(p[2], '^[0-9]{{1,18}}$') THEN p[2]::BIGINT END AS freq FROM s WHERE len(p) = 2""")
def vocab_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents, and for each a line of a vocabulary, read as vocabulary lines."""
    rows = lines(spark, sf_dir)
    both = rows.select("text").unionByName(rows.select(F.concat_ws(" ", "source", F.col("line_no").cast("string")).alias("text")))
    good, _ = vocabulary_lines(both)
    return good.select("token", "freq")


@query(f"""WITH {LINES} SELECT doc_id, line_no::INT AS line_no, text, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(text, ''), lambda c: printf('%08X', unicode(c))), '') END AS points FROM lines WHERE len(string_split(regexp_replace(text, '^[\\r\\n ]+|[\\r\\n ]+$', '', 'g'), ' ')) <> 2""")
def vocab_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are no vocabulary lines, and their code points."""
    _, bad = vocabulary_lines(lines(spark, sf_dir))
    return bad.select("doc_id", "line_no", "text", "points")


@query(f"""WITH d AS (SELECT doc_id, string_split({strip_sql("replace(coalesce(text, ''), chr(10), ' ')")}, ' ') AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS token, unnest(generate_series(1, len(l))) AS place FROM d),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS id FROM w WHERE token <> '' GROUP BY token HAVING count(*) >= 5),
e AS (SELECT doc_id, count(*) AS n, string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY place) AS ids FROM w LEFT JOIN v USING (token) WHERE token <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, sha256(coalesce(ids, '')) AS ids FROM documents LEFT JOIN e USING (doc_id)""")
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("text"))
    return vocabulary.encode(docs, vocabulary.numbered(vocabulary.token_counts(docs)), "doc_id").select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), 256).alias("ids"))


# Metrics: one system copies the reference with a word less, the other drops every fifth word


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("pair", "line_no", F.col("tgt_text").alias("ref"), tx.pieces_of(F.col("tgt_text")).alias("w"))
    a = F.array_join(F.slice("w", 2, F.size("w")), " ")
    b = F.array_join(F.filter("w", lambda _, i: i % 5 != 4), " ")
    return rows.select("pair", "line_no", "ref", F.explode(F.array(F.struct(F.lit("a").alias("system"), a.alias("hyp")), F.struct(F.lit("b").alias("system"), b.alias("hyp")))).alias("s")).select("pair", "line_no", "ref", "s.*")


_SYSTEMS = f"""{TURNS}, w AS (SELECT pair, line_no, tgt_text AS ref, string_split({strip_sql("tgt_text")}, ' ') AS w FROM turns),
systems AS (SELECT pair, line_no, ref, 'a' AS system, array_to_string(w[2:], ' ') AS hyp FROM w
  UNION ALL SELECT pair, line_no, ref, 'b', array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: (i - 1) % 5 <> 4), lambda i: w[i]), ' ') FROM w)"""


def _grams_sql(items: str, most: int) -> str:
    return f"""sides AS (SELECT pair, line_no, system, 0 AS side, {items.replace("{x}", "hyp")} AS l FROM systems UNION ALL SELECT pair, line_no, system, 1, {items.replace("{x}", "ref")} FROM systems),
grams AS (SELECT pair, line_no, system, side, n, unnest(list_transform(generate_series(1, len(l) - n + 1), lambda i: array_to_string(l[i : i + n - 1], chr(1)))) AS gram FROM sides, (SELECT unnest(generate_series(1, {most})) AS n) WHERE len(l) >= n),
stats AS (SELECT pair, line_no, system, n, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r FROM grams GROUP BY pair, line_no, system, n, gram),
sums AS (SELECT pair, system, n, sum(m)::DOUBLE AS m, sum(h)::DOUBLE AS h, sum(r)::DOUBLE AS r FROM stats GROUP BY pair, system, n)"""


_WORDS = r"list_filter(string_split_regex(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+'), lambda t: t <> '')"
_CHARS = r"list_filter(string_split(regexp_replace({x}, '\s+', '', 'g'), ''), lambda t: t <> '')"


@query(f"""WITH {_SYSTEMS}, {_grams_sql(_WORDS, 4)}
SELECT pair, system, round(CASE WHEN min(m) > 0 AND count(*) = 4 THEN least(1, exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1))) * exp(avg(ln(100 * m / h))) END, 6) AS bleu FROM sums GROUP BY pair, system""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["pair", "system"]
    return metrics.bleu(metrics.bleu_statistics(systems(spark, sf_dir), [*groups, "line_no"]), groups).select(*groups, F.round("bleu", 6).alias("bleu"))


@query(f"""WITH {_SYSTEMS}, {_grams_sql(_CHARS, 6)}, pr AS (SELECT pair, system, avg(m / h) AS p, avg(m / r) AS q FROM sums WHERE h > 0 AND r > 0 GROUP BY pair, system)
SELECT pair, system, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM pr""")
def chrf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["pair", "system"]
    return metrics.chrf(metrics.chrf_statistics(systems(spark, sf_dir), [*groups, "line_no"]), groups).select(*groups, F.round("chrf", 6).alias("chrf"))


# A word's mark at its end, or else the one at its start, as a word of its own
_MARK = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_PARTS = rf"""flatten(list_transform({_WORDS}, lambda t: CASE WHEN length(t) = 1 THEN [t] WHEN regexp_matches(t, '{_MARK}$') THEN [t[:-2], t[-1]]
  WHEN regexp_matches(t, '^{_MARK}') THEN [t[1], t[2:]] ELSE [t] END))"""


@query(f"""WITH {_SYSTEMS}, chars AS (WITH {_grams_sql(_CHARS, 6)} SELECT * FROM sums), words AS (WITH {_grams_sql(_PARTS, 2)} SELECT * FROM sums),
pr AS (SELECT pair, system, avg(m / h) AS p, avg(m / r) AS q FROM (FROM chars UNION ALL FROM words) WHERE h > 0 AND r > 0 GROUP BY pair, system)
SELECT pair, system, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM pr""")
def chrfpp_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["pair", "system"]
    return metrics.chrf(metrics.chrf_statistics(systems(spark, sf_dir), [*groups, "line_no"], 2), groups).select(*groups, F.round("chrf", 6).alias("chrf"))


# The steps of mteval-v13a: entities, then every ASCII mark but apostrophe, hyphen, comma and dot, then these where no digit is beside them
_V13A = replaced_sql("(' ' || {x} || ' ')", ("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "chr(34)"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"))
_V13A = _WORDS.replace("{x}", subbed_sql(_V13A, (r"([ !-&(-+/:-@\x5B-`{-~])", r" \1 "), ("([^0-9])([.,])", r"\1 \2 "), ("([.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 ")))


@query(f"""WITH {_SYSTEMS}, {_grams_sql(_V13A, 4)}
SELECT pair, system, round(CASE WHEN min(m) > 0 AND count(*) = 4 THEN least(1, exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1))) * exp(avg(ln(100 * m / h))) END, 6) AS bleu FROM sums GROUP BY pair, system""")
def bleu_13a_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["pair", "system"]
    return metrics.bleu(metrics.bleu_statistics(systems(spark, sf_dir), [*groups, "line_no"], "13a"), groups).select(*groups, F.round("bleu", 6).alias("bleu"))


_TIMES = " + ".join(f"(u > {limit}::DOUBLE)::INT" for limit in metrics.POISSON)


@query(f"""WITH {_SYSTEMS}, {_grams_sql(_WORDS, 4)}, l AS (SELECT line_no, system, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM stats GROUP BY ALL),
k AS (SELECT sample, line_no, ('0x' || left(md5(sample || ':' || line_no), 8))::BIGINT / 4294967296::DOUBLE AS u FROM (SELECT unnest(generate_series(1, 200)) AS sample), (SELECT DISTINCT line_no FROM l)),
t AS (SELECT sample, line_no, {_TIMES} AS times FROM k),
b AS (SELECT sample, system, n, sum(m * times)::DOUBLE AS m, sum(h * times)::DOUBLE AS h, sum(r * times)::DOUBLE AS r FROM l JOIN t USING (line_no) WHERE times > 0 GROUP BY ALL),
z AS (SELECT sample, system, round(least(1, exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1))) * exp(avg(ln(100 * m / h))), 6) AS bleu FROM b GROUP BY ALL)
SELECT sample::INT AS sample, max(bleu) FILTER (system = 'a') AS a, max(bleu) FILTER (system = 'b') AS b, max(bleu) FILTER (system = 'a') > max(bleu) FILTER (system = 'b') AS a_wins FROM z GROUP BY sample""")
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.bleu_statistics(systems(spark, sf_dir).drop("pair"), ["line_no", "system"])
    scores = metrics.paired_bootstrap(stats, "line_no", "system")
    return scores.groupBy("sample").pivot("system", ["a", "b"]).agg(F.round(F.first("bleu"), 6)).withColumn("a_wins", F.col("a") > F.col("b"))


# Several systems against one


def three_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As systems(), and a third that drops every seventh word."""
    words = tx.pieces_of(F.col("tgt_text"))
    own = turns(spark, sf_dir).select("pair", "line_no", F.col("tgt_text").alias("ref"), F.lit("c").alias("system"), F.array_join(F.filter(words, lambda _, i: i % 7 != 6), " ").alias("hyp"))
    return systems(spark, sf_dir).unionByName(own)


_THREE = _SYSTEMS[:-1] + """
  UNION ALL SELECT pair, line_no, ref, 'c', array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: (i - 1) % 7 <> 6), lambda i: w[i]), ' ') FROM w)"""


@query(f"""WITH {_THREE}, {_grams_sql(_WORDS, 4)}, l AS (SELECT line_no, system, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM stats GROUP BY ALL),
k AS (SELECT sample, line_no, ('0x' || left(md5(sample || ':' || line_no), 8))::BIGINT / 4294967296::DOUBLE AS u FROM (SELECT unnest(generate_series(1, 200)) AS sample), (SELECT DISTINCT line_no FROM l)),
t AS (SELECT sample, line_no, {_TIMES} AS times FROM k UNION ALL SELECT 0, line_no, 1 FROM (SELECT DISTINCT line_no FROM l)),
b AS (SELECT sample, system, n, sum(m * times)::DOUBLE AS m, sum(h * times)::DOUBLE AS h, sum(r * times)::DOUBLE AS r FROM l JOIN t USING (line_no) WHERE times > 0 GROUP BY ALL),
z AS (SELECT sample, system, least(1, exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1))) * exp(avg(ln(100 * m / h))) AS bleu FROM b GROUP BY ALL),
d AS (SELECT z.system, z.sample, z.bleu, abs(z.bleu - o.bleu) AS diff FROM z JOIN z o ON o.sample = z.sample AND o.system = 'a'),
g AS (SELECT system, avg(diff) FILTER (sample > 0) AS mid, max(diff) FILTER (sample = 0) AS seen FROM d GROUP BY system)
SELECT system, round(max(bleu) FILTER (sample = 0), 6) AS bleu, round(avg(bleu) FILTER (sample > 0), 6) AS mean,
  CASE WHEN system <> 'a' THEN round((count(*) FILTER (sample > 0 AND abs(diff - mid) > seen) + 1) / 201, 6) END AS p_value FROM d JOIN g USING (system) GROUP BY system""")
def bootstrap_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems against a baseline by paired resampling."""
    stats = metrics.bleu_statistics(three_systems(spark, sf_dir).drop("pair"), ["line_no", "system"])
    return metrics.significance(stats, "line_no", "system", "a").select("system", *(F.round(c, 6).alias(c) for c in ("bleu", "mean", "p_value")))


# Whole jobs


@query(" UNION ALL ".join(f"SELECT pair, system, '{m}' AS metric, {c} AS value FROM ({SQL[q]})" for m, c, q in (("bleu", "bleu", "bleu_corpus"), ("chrf", "chrf", "chrf_corpus"), ("chrf++", "chrf", "chrfpp_corpus"))))
def evaluate_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of both systems, predictions and references aligned by line."""
    rows = systems(spark, sf_dir)
    predictions = rows.select("pair", "system", "line_no", F.col("hyp").alias("text"))
    references = turns(spark, sf_dir).select("pair", "line_no", F.col("tgt_text").alias("text"))
    return prepare.evaluate(predictions, references).withColumn("value", F.round("value", 6))


def _scores_sql(rows: str) -> str:
    """BLEU with halved imagined matches, chrF and chrF++ of rows (pair, line_no, ref, system, hyp)."""
    logs = "CASE WHEN m = 0 THEN ln(100 / (pow(2, count(*) FILTER (m = 0) OVER (PARTITION BY pair, system ORDER BY n)) * h)) ELSE ln(100 * m / h) END"
    bleu = f"""SELECT pair, system, 'bleu' AS metric, round(CASE WHEN count(*) < 4 OR max(m) FILTER (n = 1) = 0 THEN 0 ELSE least(1, exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1))) * exp(avg(l)) END, 6) AS value
  FROM (SELECT *, {logs} AS l FROM (WITH {_grams_sql(_WORDS, 4)} SELECT * FROM sums WHERE h > 0)) GROUP BY pair, system"""
    score = "round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6)"
    chrf = f"SELECT pair, system, 'chrf' AS metric, {score} AS value FROM (SELECT pair, system, avg(m / h) AS p, avg(m / r) AS q FROM chars WHERE h > 0 AND r > 0 GROUP BY pair, system)"
    chrfpp = f"SELECT pair, system, 'chrf++' AS metric, {score} AS value FROM (SELECT pair, system, avg(m / h) AS p, avg(m / r) AS q FROM (FROM chars UNION ALL FROM parts) WHERE h > 0 AND r > 0 GROUP BY pair, system)"
    return f"""WITH {TURNS}, systems AS ({rows}), chars AS MATERIALIZED (WITH {_grams_sql(_CHARS, 6)} SELECT * FROM sums), parts AS (WITH {_grams_sql(_PARTS, 2)} SELECT * FROM sums)
{bleu} UNION ALL {chrf} UNION ALL {chrfpp}"""


_DIRECTIONS = """SELECT pair, line_no, tgt_text AS ref, 'forward' AS system, tgt_lang || ': ' || src_text AS hyp FROM turns
UNION ALL SELECT tgt_lang || '-' || src_lang, line_no, src_text, 'reversed', src_lang || ': ' || tgt_text FROM turns
UNION ALL SELECT pair, line_no, tgt_text, 'pivoted', tgt_lang || ': eng_Latn: ' || src_text FROM turns WHERE 'eng_Latn' NOT IN (src_lang, tgt_lang)"""


@query(_scores_sql(_DIRECTIONS))
def evaluate_directions_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in translator scored forward, backward and, for pairs without English, over English."""
    ship(spark)
    told = prepare.evaluate_translator(turns(spark, sf_dir), translation.echo, pivot="eng_Latn")
    return told.withColumn("value", F.round("value", 6))


def _prepare_sql() -> str:
    punctuated = lambda text, code: f"CASE WHEN {code} = 'eng_Latn' THEN {corpus_sql(text, 'en')} ELSE {corpus_sql(text, 'hi')} END"
    kept = SQL["decontam_loose_pairs"].replace("SELECT line_no, pair,", "SELECT line_no, pair, src_lang, tgt_lang,").split("WITH ", 1)[1]
    head, select = kept.rsplit("\nSELECT line_no, pair, src_lang", 1)
    return f"""WITH {head}, kept AS (SELECT line_no, pair, src_lang{select}),
one AS (SELECT pair, src_lang, tgt_lang, min(line_no) AS line_no, src_text, tgt_text FROM kept GROUP BY ALL),
t AS (SELECT line_no, pair, src_lang, tgt_lang, {punctuated("src_text", "src_lang")} AS x, {punctuated("tgt_text", "tgt_lang")} AS y FROM one),
{wrap_pair_steps_sql("t", "line_no, pair, src_lang, tgt_lang")}, z AS (SELECT line_no, pair, src_lang, tgt_lang, {strip_sql("x")} AS x, {_UNWRAPPED("y")} AS y FROM w4)
SELECT line_no, pair, src_lang || ' ' || tgt_lang || ' ' || x AS src_text, y AS tgt_text FROM z WHERE {_pieces("x")} <= 200 AND {_pieces("y")} <= 200"""


@query(_prepare_sql())
def prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and benchmark lines made ready for training: decontaminated, distinct, normalised, tagged, of at most 200 pieces."""
    return prepare.prepare(_turns_with_bench(spark, sf_dir), _by_lang(spark, sf_dir), 200).select("line_no", "pair", "src_text", "tgt_text")


# Further operators on pairs


@query(f"""WITH {TURNS} SELECT line_no, pair, src_text, tgt_text FROM turns WHERE src_lang <> tgt_lang""")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.strict_bitext(turns(spark, sf_dir)).select("line_no", "pair", "src_text", "tgt_text")


@query(f"""WITH {TURNS} SELECT line_no, pair, src_text, tgt_text FROM turns WHERE line_no % 3 > 0 AND line_no % 5 > 0""")
def align_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides that lack every third and every fifth line, put together by line."""
    rows = turns(spark, sf_dir)
    return corpus.align(rows.filter("line_no % 3 > 0").select("pair", "line_no", "src_text"), rows.filter("line_no % 5 > 0").select("pair", "line_no", "tgt_text"), ["pair", "line_no"])


@query(f"""WITH {TURNS}, d AS (SELECT * FROM {values_sql(lang.iso_rows(), "iso, flores")}), i AS (SELECT flores, min(iso) AS iso FROM d GROUP BY flores)
SELECT line_no, coalesce(a.flores, 'xx') || '-' || tgt_lang AS pair, coalesce(a.flores, 'xx') AS src_lang, tgt_lang FROM (
  SELECT line_no, CASE WHEN line_no % 2 = 0 THEN 'xx' ELSE s.iso END AS iso, tgt_lang FROM turns JOIN i s ON s.flores = src_lang) LEFT JOIN d a USING (iso)""")
def full_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with short codes, or none that is known, renamed to full codes."""
    dim = lang.iso_dim(spark)
    short = dim.groupBy("flores").agg(F.min("iso").alias("iso"))
    rows = turns(spark, sf_dir).join(F.broadcast(short.withColumnRenamed("flores", "src_lang")), "src_lang")  # 38 rows
    rows = rows.withColumn("src_lang", F.when(F.col("line_no") % 2 == 0, "xx").otherwise(F.col("iso"))).drop("iso")
    return corpus.to_full_codes(rows, dim).select("line_no", "pair", "src_lang", "tgt_lang")


@query(f"""WITH {TURNS} SELECT line_no, 'eng_Latn-' || CASE WHEN tgt_lang = 'eng_Latn' THEN src_lang ELSE tgt_lang END AS pair,
CASE WHEN tgt_lang = 'eng_Latn' THEN tgt_text ELSE src_text END AS src_text, CASE WHEN tgt_lang = 'eng_Latn' THEN src_text ELSE tgt_text END AS tgt_text FROM turns WHERE 'eng_Latn' IN (src_lang, tgt_lang)""")
def pivot_as_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pivot_first(turns(spark, sf_dir)).select("line_no", "pair", "src_text", "tgt_text")


@query(f"""WITH {TURNS}, f AS (SELECT DISTINCT pair, CASE WHEN line_no % 2 = 0 OR pair LIKE 'tam%' THEN src_lang ELSE tgt_lang END AS lang FROM turns)
SELECT pair, lang FROM f WHERE pair IN (SELECT pair FROM f GROUP BY pair HAVING count(*) = 2)""")
def files_of_whole_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when((F.col("line_no") % 2 == 0) | F.col("pair").startswith("tam"), F.col("src_lang")).otherwise(F.col("tgt_lang"))
    return corpus.complete_pairs(turns(spark, sf_dir).select("pair", own.alias("lang")).distinct()).select("pair", "lang")


_NAMES = sorted({x for x, *_ in lang.system_rows()})


@query(f"""WITH {TURNS}, s AS (SELECT line_no, pair, [{", ".join(f"'{x}'" for x in _NAMES)}][line_no % {len(_NAMES)} + 1] AS system FROM turns) SELECT line_no, pair, system FROM s WHERE contains(system, 'b')""")
def system_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of predictions (the turns, dealt to all systems) those of the systems that are asked for."""
    names = F.array(*map(F.lit, _NAMES))
    return lang.systems_named(turns(spark, sf_dir).select("line_no", "pair", F.get(names, F.col("line_no") % len(_NAMES)).alias("system")), "b")


@query(f"""WITH {TURNS} SELECT line_no, pair, row_number() OVER (ORDER BY md5('7:' || line_no), line_no) - 1 AS place FROM turns""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shuffled_places(turns(spark, sf_dir).select("line_no", "pair"), 7, "line_no")


@query()
def sample_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten predictions to look at."""
    return corpus.sample(systems(spark, sf_dir).select("pair", "line_no", "system", "hyp"), 10, seed=3)


_LEFT = " " + " ".join(["؟", "۔", "،", "ٮ۪", "ଯ଼"])
_CODE = "['urd_Arab', 'ory_Orya', 'kas_Aran', 'eng_Latn'][line_no % 4 + 1]"


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no::INT AS line_no, text || '{_LEFT}' AS x, {_CODE} AS code FROM lines)
SELECT doc_id, line_no, CASE WHEN right(code, 5) IN ('_Arab', '_Aran') THEN replace(replace(replace(replace(x, ' ؟', '؟'), ' ۔', '۔'), ' ،', '،'), 'ٮ۪', 'ؠ')
  WHEN code LIKE 'ory%' THEN replace(x, 'ଯ଼', 'ୟ') ELSE x END AS out FROM m""")
def script_mend(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*(F.lit(c) for c in ("urd_Arab", "ory_Orya", "kas_Aran", "eng_Latn"))), F.col("line_no") % 4)
    return lines(spark, sf_dir).select("doc_id", "line_no", tx.mend_script(F.concat("text", F.lit(_LEFT)), code).alias("out"))


@query(SQL["dnt_wrap"])
def tags_mend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that were taken apart, and digits between them that were spaced, against the texts before."""
    raw = lines(spark, sf_dir).select("doc_id", "line_no", tx.wrap(_mixed()).alias("raw"))
    apart = F.replace(F.replace(F.regexp_replace("raw", "([0-9])([:/.][0-9])(?=[^<]*</dnt>)", "$1 $2"), F.lit("<dnt>"), F.lit("< dnt >")), F.lit("</dnt>"), F.lit("< / dnt >"))
    return raw.select("doc_id", "line_no", tx.mend_tags(apart, F.col("raw")).alias("out"))


# Batches under a budget of tokens

_SIZED = f"sized AS (SELECT pair, line_no, {_pieces('src_text')} AS size FROM turns)"
_BATCHES = f"""{TURNS}, {_SIZED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY size DESC, line_no) - 1 AS r, count(*) OVER (PARTITION BY pair) AS n FROM sized),
heads AS (SELECT pair, r, n, greatest(1, {{budget}} // greatest(1, size)) AS fits FROM ranked),
starts AS (SELECT pair, 0 AS batch, r, fits, n FROM heads WHERE r = 0 UNION ALL SELECT h.pair, s.batch + 1, h.r, h.fits, h.n FROM starts s JOIN heads h ON h.pair = s.pair AND h.r = s.r + s.fits),
dealt AS (SELECT k.pair, line_no, size, batch::BIGINT AS batch FROM ranked k ASOF JOIN starts s ON s.pair = k.pair AND k.r >= s.r)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("pair", "line_no", "src_text", F.size(tx.pieces_of(F.col("src_text"))).alias("size"))


@query(f"WITH RECURSIVE {_BATCHES.format(budget=9216)} SELECT pair, line_no, batch FROM dealt")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.token_batches(_sized(spark, sf_dir), "size").select("pair", "line_no", "batch")


@query(f"""WITH RECURSIVE {_BATCHES.format(budget=256)}
SELECT pair, batch, count(*) AS texts, sum(size)::BIGINT AS tokens, (count(*) * max(size))::BIGINT AS padded, round(1 - sum(size) / (count(*) * max(size)), 6) AS waste FROM dealt GROUP BY pair, batch""")
def token_batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What batches of 256 tokens hold, and how much of it is padding."""
    batched = batching.token_batches(_sized(spark, sf_dir), "size", 256)
    return batching.padding(batched, "size").withColumn("waste", F.round("waste", 6))


@query(f"WITH {TURNS} SELECT line_no, pair, split_part(tgt_lang, '_', 1) || ': ' || src_text AS text FROM turns")
def translate_batched_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns translated by a stand-in that gets a batch under the budget at a time."""
    ship(spark)
    short = lambda c: F.substring_index(c, "_", 1)
    rows = _sized(spark, sf_dir).join(turns(spark, sf_dir).select("line_no", "src_lang", "tgt_lang"), "line_no")
    rows = rows.select("line_no", "pair", short("src_lang").alias("src"), short("tgt_lang").alias("tgt"), "size", F.col("src_text").alias("text"))
    return translation.translate_in_batches(rows, translation.echo, "size").select("line_no", "pair", "text")


# Constraints that travel with requests

_ASKED = f"""{TURNS}, w AS (SELECT line_no, tgt_lang, string_split(src_text, ' ') AS w, src_text FROM turns),
asked AS (SELECT line_no, tgt_lang || ': ' || replace(src_text, chr(9), ' ') AS hyp, list_transform([w[2], reverse(w[1]), w[len(w) - 1] || ' ' || w[len(w)], tgt_lang, ''], lambda c: replace(coalesce(c, ''), chr(9), ' ')) AS c FROM w)"""


@query(f"WITH {_ASKED} SELECT line_no, array_to_string(list_filter(c, lambda x: x <> '' AND contains(hyp, x)), chr(10)) AS met FROM asked")
def constraints_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with phrases behind tabs: words of the text, one of them reversed, the last two, a language's code and an empty one."""
    ship(spark)
    w, n = F.split("src_text", " ", -1), F.size(F.split("src_text", " ", -1))
    own = F.array(F.get(w, F.lit(1)), F.reverse(F.get(w, F.lit(0))), F.concat(F.get(w, n - 2), F.lit(" "), F.get(w, n - 1)), F.col("tgt_lang"), F.lit(""))
    phrases = F.transform(own, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit(" ")))
    lines_ = turns(spark, sf_dir).select("line_no", F.col("src_lang").alias("src"), F.col("tgt_lang").alias("tgt"), F.concat(F.replace("src_text", F.lit("\t"), F.lit(" ")), F.lit("\t"), F.array_join(phrases, "\t")).alias("text"))
    done = translation.translate(translation.split_constraints(lines_), translation.echo)
    return translation.met_constraints(done).select("line_no", F.array_join("met", "\n").alias("met"))


# Sentences by the splitter that finds fewer

_ABBREVIATIONS = rf"""words AS (SELECT regexp_replace(token, '\.$', '') AS word, ends_with(token, '.') AS stop FROM (SELECT lower(unnest(string_split_regex(coalesce(text, ''), '\s+'))) AS token FROM documents)),
counts AS (SELECT word, count(*) FILTER (stop)::DOUBLE AS k, count(*) FILTER (NOT stop)::DOUBLE AS rest FROM words WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}.-]*$') GROUP BY word),
usual AS (SELECT least(sum(k) / sum(k + rest), 0.99::DOUBLE) AS p FROM counts),
sized AS (SELECT word, k, rest, p, length(word) - length(replace(word, '.', '')) AS stops, length(replace(word, '.', ''))::DOUBLE AS letters FROM counts, usual WHERE k > 0),
known AS (SELECT word, 2 * (k * ln(0.99::DOUBLE) + rest * ln(1 - 0.99::DOUBLE) - k * ln(p) - rest * ln(1 - p)) * exp(-letters) * (stops + 1) * pow(letters, -rest) AS evidence FROM sized
  WHERE 2 * (k * ln(0.99::DOUBLE) + rest * ln(1 - 0.99::DOUBLE) - k * ln(p) - rest * ln(1 - p)) * exp(-letters) * (stops + 1) * pow(letters, -rest) >= 0.3)"""


@query(f"WITH {_ABBREVIATIONS} SELECT word, round(evidence, 6) AS evidence FROM known")
def abbreviations_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.abbreviations(sentences.word_counts(table(spark, sf_dir, "documents"))).select("word", F.round("evidence", 6).alias("evidence"))


@query(rf"""WITH {SENTENCES}, {_ABBREVIATIONS}, first AS (SELECT doc_id, count(*) AS n, string_agg(text, chr(10) ORDER BY sentence_no) AS s FROM sentences GROUP BY doc_id),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]["'')\]]{{0,3}})\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS p FROM documents),
parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM cut),
told AS (SELECT doc_id, part, i, lower(regexp_extract(part, '(\p{{L}}[\p{{L}}.-]*)\.$', 1)) AS last FROM parts),
open_ AS (SELECT doc_id, part, i, last <> '' AND (length(last) = 1 OR last IN (SELECT word FROM known)) AS goes_on FROM told),
numbered AS (SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, coalesce(lag(goes_on) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM open_)),
whole AS (SELECT doc_id, k, string_agg(part, ' ' ORDER BY i) AS text FROM numbered GROUP BY doc_id, k),
second AS (SELECT doc_id, count(*) AS n, string_agg(text, chr(10) ORDER BY k) AS s FROM whole GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN 'words' ELSE 'marks' END AS "by", (CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN coalesce(b.n, 0) ELSE coalesce(a.n, 0) END)::INT AS n,
  sha256(coalesce(CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN b.s ELSE a.s END, '')) AS sentences FROM documents LEFT JOIN first a USING (doc_id) LEFT JOIN second b USING (doc_id)""")
def sentence_fewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split by marks alone and by a splitter that has learned their abbreviations, whichever finds fewer sentences."""
    found = sentences.split_fewer(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "by", F.size("sentences").alias("n"), F.sha2(F.array_join("sentences", "\n"), 256).alias("sentences"))


# Scripts

#: Letters that all nine scripts have, in Devanagari; as other scripts write them, they stand at the same places of their blocks.
_LETTERS = "कटतनपमयरलसहािीुूेो"
_SCRIPTS = [("hin_Deva", "Deva"), ("ben_Beng", "Beng"), ("tam_Taml", "Taml"), ("tel_Telu", "Telu"), ("kan_Knda", "Knda"), ("mal_Mlym", "Mlym"), ("ory_Orya", "Orya"), ("pan_Guru", "Guru"), ("guj_Gujr", "Gujr"), ("eng_Latn", None)]


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no::INT AS line_no, text, (doc_id + line_no) % {len(_SCRIPTS)} AS k FROM lines),
b AS (SELECT doc_id, line_no, text, k, [{", ".join(str(scripts.BLOCKS[s] if s else 0x900) for _, s in _SCRIPTS)}][k + 1] AS base FROM m)
SELECT doc_id, line_no, text || ' {_LETTERS}।' AS common, text || ' ' || array_to_string(list_transform(string_split('{_LETTERS}', ''), lambda c: chr((unicode(c) - 2304 + base)::INT)), '') || '।' AS own FROM b""")
def script_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with letters of ten scripts brought to the common script, and back to their own."""
    k = ((F.col("doc_id") + F.col("line_no")) % len(_SCRIPTS)).cast("int")
    own = F.get(F.array(*(F.lit("".join(chr(ord(c) - 0x900 + scripts.BLOCKS[s]) for c in _LETTERS) if s else _LETTERS) for _, s in _SCRIPTS)), k)
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.get(F.array(*(F.lit(c) for c, _ in _SCRIPTS)), k).alias("code"), F.concat("text", F.lit(" "), own, F.lit("।")).alias("x"))
    both = rows.select("doc_id", "line_no", "code", scripts.to_common(F.col("x"), F.col("code")).alias("common"))
    return both.select("doc_id", "line_no", "common", scripts.from_common(F.col("common"), F.col("code")).alias("own"))


# Systems compared


@query(f"""WITH {_THREE}, chars AS (WITH {_grams_sql(_CHARS, 6)} SELECT line_no, system, 'char' AS kind, n, m, h, r FROM stats), parts AS (WITH {_grams_sql(_PARTS, 2)} SELECT line_no, system, 'word' AS kind, n, m, h, r FROM stats),
l AS (SELECT line_no, system, kind, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM (FROM chars UNION ALL FROM parts) GROUP BY ALL),
k AS (SELECT sample, line_no, ('0x' || left(md5(sample || ':' || line_no), 8))::BIGINT / 4294967296::DOUBLE AS u FROM (SELECT unnest(generate_series(1, 100)) AS sample), (SELECT DISTINCT line_no FROM l)),
t AS (SELECT sample, line_no, {_TIMES} AS times FROM k UNION ALL SELECT 0, line_no, 1 FROM (SELECT DISTINCT line_no FROM l)),
b AS (SELECT sample, system, kind, n, sum(m * times)::DOUBLE AS m, sum(h * times)::DOUBLE AS h, sum(r * times)::DOUBLE AS r FROM l JOIN t USING (line_no) WHERE times > 0 GROUP BY ALL),
pr AS (SELECT sample, system, avg(m / h) AS p, avg(m / r) AS q FROM b WHERE h > 0 AND r > 0 GROUP BY ALL),
z AS (SELECT sample, system, CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END AS chrf FROM pr),
d AS (SELECT z.system, z.sample, z.chrf, abs(z.chrf - o.chrf) AS diff FROM z JOIN z o ON o.sample = z.sample AND o.system = 'a'),
g AS (SELECT system, avg(diff) FILTER (sample > 0) AS mid, max(diff) FILTER (sample = 0) AS seen FROM d GROUP BY system)
SELECT system, round(max(chrf) FILTER (sample = 0), 6) AS chrf, round(avg(chrf) FILTER (sample > 0), 6) AS mean,
  CASE WHEN system <> 'a' THEN round((count(*) FILTER (sample > 0 AND abs(diff - mid) > seen) + 1) / 101, 6) END AS p_value FROM d JOIN g USING (system) GROUP BY system""")
def chrfpp_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems against a baseline by paired resampling of chrF++."""
    stats = metrics.chrf_statistics(three_systems(spark, sf_dir).drop("pair"), ["line_no", "system"], 2)
    told = metrics.significance(stats, "line_no", "system", "a", 100, metrics.chrf_score, "chrf")
    return told.select("system", *(F.round(c, 6).alias(c) for c in ("chrf", "mean", "p_value")))


def by_length(sources: list[str], hyps: list[str], refs: list[str]) -> list[float]:
    """A scorer for tests: how alike the lengths of hypothesis and reference are."""
    return [(min(len(h), len(r)) + 1) / (max(len(h), len(r)) + 1) for h, r in zip(hyps, refs, strict=True)]


@query(f"""WITH {_THREE}, v AS (SELECT line_no, system, (least(length(hyp), length(ref)) + 1) / (greatest(length(hyp), length(ref)) + 1) AS v FROM systems),
m AS (SELECT p.system AS a, q.system AS b, count(*) AS n, avg(p.v) AS mean_a, avg(q.v) AS mean_b, avg(p.v - q.v) AS diff, stddev_samp(p.v - q.v) AS sd FROM v p JOIN v q ON p.line_no = q.line_no AND p.system < q.system GROUP BY ALL),
s AS (SELECT *, CASE WHEN sd > 0 THEN diff / (sd / sqrt(n)) END AS t FROM m),
i AS (SELECT *, (n - 1) / 2 AS h, (n - 1) / (n - 1 + t * t) AS x0 FROM s),
j AS (SELECT *, x0 >= (h + 1) / (h + 2.5::DOUBLE) AS flip, CASE WHEN x0 >= (h + 1) / (h + 2.5::DOUBLE) THEN {{'a': 0.5::DOUBLE, 'b': h, 'x': 1 - x0}} ELSE {{'a': h, 'b': 0.5::DOUBLE, 'x': x0}} END AS c FROM i),
f AS (SELECT *, list_reduce(list_transform(range(300, 0, -1), lambda k: k::DOUBLE), lambda y, k: -(c.a + k - 1) * (c.a + c.b + k - 1) * c.x / ((c.a + 2 * k - 2) * (c.a + 2 * k - 1)) / (1 + k * (c.b - k) * c.x / ((c.a + 2 * k - 1) * (c.a + 2 * k)) / (1 + y)), 0::DOUBLE) AS y,
  exp(lgamma(c.a + c.b) - lgamma(c.a) - lgamma(c.b) + c.a * ln(c.x) + c.b * ln(1 - c.x)) / c.a AS front FROM j)
SELECT a, b, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, round(t, 4) AS t, round(CASE WHEN flip THEN 1 - front / (1 + y) ELSE front / (1 + y) END, 6) AS p_value FROM f""")
def systems_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three systems by the scores that a plugged-in scorer gives their segments."""
    rows = three_systems(spark, sf_dir).select("line_no", "system", F.lit("").alias("src"), "hyp", "ref")
    told = metrics.compare_systems(metrics.score_segments(rows, by_length), "line_no")
    return told.select("a", "b", "n", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff")), F.round("t", 4).alias("t"), F.round("p_value", 6).alias("p_value"))


# Files and streams: what is written from the tables and read back

_PLACED = f"""{TURNS}, placed AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY line_no) - 1 AS line_no, src_lang, tgt_lang, replace(src_text, chr(10), ' ') AS src_text, replace(tgt_text, chr(10), ' ') AS tgt_text FROM turns)"""


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The turns as aligned files."""
    root = scratch(spark, "sides")
    bitext.write_sides(turns(spark, sf_dir), root)
    return root


@query(f"WITH {_PLACED} SELECT pair, line_no, src_text, tgt_text FROM placed")
def bitext_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned files read side by side and joined by line."""
    return bitext.read_bitext(spark, _files(spark, sf_dir)).select("pair", "line_no", "src_text", "tgt_text")


@query(SQL["bitext_read"])
def aligned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned files read in step, by blocks of 64 KB."""
    return aligned.read_aligned(spark, _files(spark, sf_dir), block=1 << 16).select("pair", "line_no", "src_text", "tgt_text")


@query(f"WITH {TURNS} SELECT row_number() OVER (ORDER BY src_lang, tgt_lang, line_no) - 1 AS n, replace(src_text, chr(10), ' ') AS src_text, replace(tgt_text, chr(10), ' ') AS tgt_text FROM turns")
def joint_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as one joint text, in blocks of 100,000 line numbers; a line's place is its part's, which the name tells, and its own."""
    at, flat = scratch(spark, "joint"), lambda c: F.replace(c, F.lit("\n"), F.lit(" ")).alias(c)
    bitext.write_joint(turns(spark, sf_dir).select("src_lang", "tgt_lang", "line_no", flat("src_text"), flat("tgt_text")), at, block=100_000)
    place = F.regexp_extract("path", r"part-([0-9]+)", 1).cast("long") + F.col("line_no")
    src, tgt = (bitext.read_lines(spark, f"{at}/train.{side}/part-*").select(place.alias("n"), F.col("text").alias(name)) for side, name in (("SRC", "src_text"), ("TGT", "tgt_text")))
    return src.join(tgt, "n")


@query(f"WITH {TURNS} SELECT line_no, pair, src_text, tgt_text FROM turns WHERE length(src_text) > 20 AND length(tgt_text) > 20")
def table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is read and replaced twice, by what each of two filters leaves."""
    at = scratch(spark, "table")
    tables.write_table(turns(spark, sf_dir).select("line_no", "pair", "src_text", "tgt_text"), at)
    for c in ("src_text", "tgt_text"):
        tables.write_table(tables.read_table(spark, at).filter(F.length(c) > 20), at)
    return tables.read_table(spark, at)


@query(SQL["decontam_loose_lines"])
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as a stream, without those of the benchmark, written by batches of which each is there once."""
    at, schema = scratch(spark, "stream"), "doc_id long, line_no int, text string"
    lines(spark, sf_dir).select("doc_id", "line_no", "text").write.parquet(f"{at}/in")
    pool = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n", -1)).alias("text")).filter(tx.strip(F.col("text")) != "")
    asked = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{at}/in")
    sink = normalize.decontaminated(asked, pool).select("doc_id", "line_no", "text").writeStream.foreachBatch(tables.once(f"{at}/out"))
    sink.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return tables.read_batches(spark, f"{at}/out", schema).select("doc_id", "line_no", "text")
