"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's ``docs``. All but the last return the
columns of ``documents``.

1. language_id: texts without a determined language go: no letter, or distinct n-grams
   that resemble no learned language (``PER_GRAM``, ``SURE``, ``SPREAD``), whatever the text repeats.
2. near_duplicates: of the texts linked by shingles of five words and Jaccard
   0.8 or more, the one with the smallest id stays. Rows whose id is null or
   repeated are documents of their own: they link by their texts like others and give
   way to a row with an id of its own; of equal rows one stays. Rows without words all stay.
3. secrets: found secrets are replaced by a mark; no document goes.
4. mixing: rows are replicated to the target weights of their sources (the
   square root of a source's size) and shuffled globally.
5. byte_bpe: adds packed token ids, their number, and whether they decode to
   the text's bytes; columns of the input that are named like these come out as ``<name>_in``.

Columns that have the names an operator uses for its own pass through unchanged
(names that start with ``__`` are reserved).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import bloom, bpe, jaccard, langid, mixing, secrets
from adlens.llm.common import WORD, keep_table, read

#: Distinct n-grams of a learned language add up: a text of k of them has a cosine of about 0.044 * sqrt(k) with
#: its prototype until it nears 1, other letters one of about 0 +- 0.03. A text is of a learned language from
#: half of that on (at most SURE), less the SPREAD of chance, which decides alone in texts of a few letters.
PER_GRAM, SURE, SPREAD = 0.02, 0.25, 0.04


def _aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that an operator's own names would replace renamed, and the names to give back."""
    back = {f"__own_{c}": c for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = ["lang_pred", "score", "n_grams", "set_score"]
    rows, back = _aside(docs, new)
    enough = F.least(F.lit(SURE), F.lit(PER_GRAM) * F.sqrt("n_grams")) - SPREAD
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("set_score") >= enough)
    kept = langid.identify(rows, evidence=True).where(known).drop(*new)
    return kept.withColumnsRenamed(back).select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``__key``: the id of a row that has one of its own, else a negative number hashed from id
    and text. Whether there are such rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__of"))
    again = keep_table(ids.groupBy("__of").count().where("count > 1 or __of is null").select("__of", F.lit(True).alias("__again")),
                       "pipeline-ids")
    own = F.col("doc_id").cast("long")
    if again.isEmpty():
        return docs.withColumn("__key", own), False
    hashed = F.xxhash64(own, F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    rows = docs.join(again, own.eqNullSafe(F.col("__of")), "left").drop("__of")
    return keep_table(rows.withColumn("__key", F.when(F.col("__again"), hashed).otherwise(own)).drop("__again"),
                      "pipeline-keyed"), True


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, repeated = _keyed(docs)
    groups = keep_table(jaccard.jaccard_components(rows, id_col="__key", words=5, percent=80), "pipeline-groups")
    if repeated:  # of a group's rows, one with an id of its own stays before the others
        first = F.min(F.struct((F.col("__key") < 0).alias("later"), F.col("__key").alias("key")))
        chosen = groups.groupBy("component_id").agg(first.alias("first"))
        groups = keep_table(groups.join(chosen, "component_id").withColumn("component_id", F.col("first.key")).drop("first"),
                            "pipeline-chosen")
    stays = groups.where("__key = component_id").select("__key").distinct()
    several = groups.where("n_shingles > 0").groupBy("__key").count().where("count > 1").select("__key")
    doubtful = groups.where("__key <> component_id").select("__key").unionByName(several)
    marked = bloom.tagged(rows, "__key", doubtful, "__key", "__maybe")  # the others stay without a join
    doubted = marked.where("__maybe").join(stays, "__key", "left_semi")
    # rows without words are no copies of each other
    worded = F.col("text").rlike(WORD)
    once = doubted.where(worded).dropDuplicates(["__key"]).unionByName(doubted.where(~F.coalesce(worded, F.lit(False))))
    return marked.where("not __maybe").unionByName(once).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, ["mix_copy", "mix_key"])
    return mixing.mix_sources(rows).drop("mix_copy", "mix_key").withColumnsRenamed(back).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, ["ids", "decoded", "n_tokens", "round_trip"])
    both = bpe.encode(rows, rank_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      pattern=public_tokenizers.PATTERN, decoded_col="decoded")
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    new = [F.col("ids"), (F.length("ids") / 4).cast("long").alias("n_tokens"), whole.alias("round_trip")]
    free = {own: c if c.lower() == "decoded" else f"{c}_in" for own, c in back.items()}
    return both.select(*(F.col(c).alias(free.get(c, c)) for c in rows.columns), *new)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secret_scan),
          ("mixing", mixing_sources), ("byte_bpe", byte_bpe)]

#: The language model's decisions and the shingle hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
