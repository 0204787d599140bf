"""One query for each text operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, byte_bpe, class_lm, decontaminate, language_id, licenses, minhash_dedup, quality, secrets, token_store
from ._work import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of(F.col("doc_id"), 10) == 0)
    return class_lm.train_and_score(docs)


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket_of(F.col("doc_id"), 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")), vocabulary("piece_bpe_32k.model"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_store.digests(spark, folder)


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of(F.col("doc_id"), 4) == 2)
    model = quality.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = licenses.train(licenses.labelled_samples(spark))
    found = licenses.find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    spans = F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["family"]))), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_found"), families.alias("families"), spans.alias("spans"))


@query
def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = bm25.top_k(docs, docs.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"), k=10)
    return best.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# ---- SQL, where it can express an operator

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_SPACED, _ALNUM = _WORDS.format(r"[^\x20\x09-\x0D]+"), _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ORACLE_SQL["op2_minhash_dedup"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, p FROM (
        SELECT doc_id, array_to_string(w[k : k + 4], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') AS p FROM d WHERE len(w) BETWEEN 1 AND 4)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.p = b.p AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    link AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN link l ON r.b = l.x),
    least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n USING (doc_id)"""
ORACLE_SQL["op6_decontaminate"] = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
    b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS p FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM b)),
    dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, k, n FROM dw WHERE p IN (SELECT p FROM bw)),
    pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS x FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM dw JOIN bw USING (p)) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""
# sums in another order differ in their last digits: ranks go by 9 decimals, where texts of other words have no ties
ORACLE_SQL["op10_bm25"] = f"""WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
    t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1e-9) AS mean FROM d),
    p AS (SELECT t.doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS worth FROM t JOIN f USING (term) JOIN d ON d.doc_id = t.doc_id, s),
    hit AS (SELECT q.doc_id AS query_id, p.doc_id, sum(worth) AS score FROM t q JOIN p USING (term) WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, p.doc_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hit) WHERE rank <= 10"""
