"""The thin queries over the whole driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import audit, chat, contamination, fingerprint, language_id, lm_scoring, mixing, oracle, quality, secrets, similarity, spelling, substrings, toxicity
from .labelled import remainder
from .scratch import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the benchmark contaminates, and by which items.

    Null texts have no words and are hit by nothing; null doc_ids and repeated rows are judged row by row; long texts and long items are
    searched whole (an item beyond 4 MB in overlapping pieces).  Ties between longest matches go to the least place.  Without documents no
    rows; without benchmark nothing is contaminated.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, c = contamination.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(f"{c}.n_words").alias("n_words"),
        contamination.n_hit(c).alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"),
        contamination.is_contaminated(c).alias("contaminated"),
        F.col(f"{c}.longest").alias("longest_match"),
        F.coalesce(f"{c}.longest_at", F.lit(-1)).alias("longest_match_at"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity of every document, from labels of documents whose crc32 mod 3 is not 1.

    Null and empty texts have the score of no words; rows without doc_id are not held out, nor learned from; repeated rows stay;
    texts are read whole.  Without labels every grade is 0; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored, c = toxicity.annotate(docs, model)
    levels = [F.col(f"{c}.at_least")[k].alias(f"p_grade_{k + 1}") for k in range(toxicity.GRADES - 1)]
    return scored.select("doc_id", held_out.alias("held_out"), F.col(f"{c}.severity").alias("severity"), F.col(f"{c}.grade").alias("grade"), (F.col(f"{c}.grade") > 0).alias("toxic"), *levels)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under the base and under the model.

    Null and empty texts are one end token; rows without doc_id are scored and learned from as the lm_scoring module says; repeated
    rows count each; long texts are scored whole, in overlapping windows.  An empty table gives no rows.
    """
    return lm_scoring.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, from labels of documents whose crc32 mod 3 is not 1.

    Null and empty texts have the score of no words; rows without doc_id are not held out, nor learned from; repeated rows stay;
    texts are read whole.  Without labels every score is 0.5; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored, c = quality.annotate(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col(f"{c}.score").alias("score"), F.col(f"{c}.predicted").alias("predicted"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, formatted and read back.

    Null texts and roles are empty; turns of one number are ordered by role and text, null turns come first; repeated turns stay; rows
    without conv_id are one conversation.  Long texts are formatted whole.  An empty table leaves conversation -1.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    chats = chat.format_chats(turns.unionByName(extra))
    back, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    told = chats.select("conv_id", back.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document, as spans of code points.

    Null and empty texts have none; null doc_ids and repeated rows are searched row by row, long texts whole.  Spans that begin
    together are in the order of the rules.  An empty table gives no rows.
    """
    found, s = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(s, lambda x: x["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col(s)).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of a mix of all sources.

    Null sources are one source, null texts have no tokens and are drawn once a source at least; equal rows are drawn each; long texts
    are drawn whole.  An empty table gives no rows.
    """
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that a document with a smaller doc_id has.

    Null texts have no words; rows without doc_id keep theirs; rows of one doc_id don't remove each other's words; long texts are
    read whole.  An empty table gives no rows.
    """
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least doc_id that links of near-duplicates lead to.

    Null and empty texts are linked with nothing; rows that share a doc_id are linked each by its own text; null doc_ids name a
    component only where it has no other; copies are linked through their set; long texts are read whole.  An empty table gives no rows.
    """
    return similarity.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to the next one's.

    Null texts are empty; null doc_ids come first; rows of one doc_id are in the order of their texts; long texts are read whole.  A
    single row is its own next one; an empty table gives no rows.
    """
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their spelling variants.

    Null texts have no words, a null doc_id is the empty string in the crc32, repeated rows count each, texts are read
    whole, and ties between forms go to the least word.  An empty table gives no rows.
    """
    words = spelling.word_counts(table(spark, sf_dir, "documents"), slips=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do to each source of documents, in all their orders.

    Null texts are empty, null sources the empty string; repeated rows count each, and only a smaller doc_id
    makes a text repeated, so null ids do not.  Long texts are counted whole; an empty table gives no rows.
    """
    return audit.audit(audit.histogram(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document.

    Null texts and texts without a letter are ``und`` with a score of 0; rows without doc_id are not held out, nor learned from;
    rows without lang are predicted, not learned from.  Repeated rows stay; long texts are read whole; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    named, c = language_id.annotate(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), F.col(f"{c}.lang").alias("lang_pred"), F.col(f"{c}.score").alias("score"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scores": op3_lm_scores,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_substrings": op8_substrings,
    "op9_jaccard": op9_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}
ORACLE_SQL = {"op1_decontamination": oracle.DECONTAMINATION, "op8_substrings": oracle.SUBSTRINGS, "op9_jaccard": oracle.JACCARD} | {"op5_chat_format": oracle.CHAT_FORMAT, "op6_secrets": oracle.SECRETS, "op12_filter_audit": oracle.FILTER_AUDIT}
