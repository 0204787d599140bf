"""From documents to token ids: language, near-duplicates, contamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns; the last
returns token ids.  A document is known by its id together with a hash of its text, so repeated or null
ids don't mix documents up; a row that repeats both is the same document, of which one row stays.  Null texts have no language and go at
the first stage, as do empty ones.  An empty table passes through all stages.  Columns beside those of documents stay, whatever
their names; the last stage gives its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import byte_bpe, decontaminate, language_id, minhash_dedup, secrets
from quillvec.llm._work import materialize, table, unused
from quillvec.llm.queries import vocabulary

#: SQL can't express any of the models.
ORACLE_SQL = None


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(F.col("doc_id").alias("id"), _text_key().alias("text_key")).alias("doc_id"), "text")


def _named(docs: DataFrame, id_: Column, text_key: Column, names: list[str]) -> DataFrame:
    """docs with columns that tell a document: whether its id is null, its id as text, and the hash of its text."""
    return docs.withColumns(dict(zip(names, (id_.isNull(), F.coalesce(id_.cast("string"), F.lit("")), text_key), strict=True)))


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> tuple[DataFrame, list[str]]:
    """docs whose key is, or is not, among the structs of keys (doc_id), with the columns of the key."""
    names = [unused(docs, x) for x in ("null", "id", "key")]
    keys = _named(keys.select("doc_id"), F.col("doc_id.id"), F.col("doc_id.text_key"), names).select(*names).distinct()
    return _named(docs, F.col("doc_id"), _text_key(), names).join(keys, names, how), names


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a probability of at least a half; rejects those without letters."""
    model = language_id.train(docs, vocabulary("piece_bpe_32k.model"))
    pred, score = unused(docs, "pred"), unused(docs, "score")
    judged = language_id.identify(docs, model, pred=pred, score=score)
    return judged.where((F.col(pred) != language_id.UNDECIDED) & (F.col(score) >= 0.5)).drop(pred, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (similarity 0.8), and every document without words.

    Of rows that repeat id and text the one whose other columns have the least hash stays, in whatever order they come.
    """
    kept = minhash_dedup.near_duplicates(_keyed(docs), percent=80).where("kept")
    once, names = _matching(docs, kept, "left_semi")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(F.lit(0), *others))
    return once.groupBy(*names).agg(row.alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any window of a benchmark item."""
    hit = decontaminate.overlaps(_keyed(docs), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    kept, names = _matching(docs, hit, "left_anti")
    return kept.select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows where there is such a column."""
    model = secrets.train(secrets.labelled_samples(spark))
    spans = unused(docs, "spans")
    found = secrets.find_secrets(docs, model, spans=spans)
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans))).drop(spans)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their digest, and whether they decode to the text again."""
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), same.alias("round_trip"), "ids")


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
