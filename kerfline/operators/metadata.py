"""Document metadata: quality score, references, compliance edges, registry, parsing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, hits, let


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def completeness(df: DataFrame, default_level: str = "Internal") -> DataFrame:
    """Adds ``score`` (sum of the weights of what is filled in) and ``status``."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    flags = {
        "has_version": filled(F.col("version")),
        "has_date": F.col("creation_date").isNotNull() | F.col("last_modified").isNotNull(),
        "has_author": filled(F.col("author")),
        "has_approver": filled(F.col("approver")),
        "has_classification": F.coalesce(F.col("classification_level"), F.lit("")) != default_level,
        "has_references": some("related_documents") | some("supersedes"),
        "has_doc_code": filled(F.col("document_code")),
        "has_owner": filled(F.col("owner")),
    }
    score = F.lit(0.0)
    for name, test in flags.items():
        score = score + F.when(test, L.QUALITY_WEIGHTS[name]).otherwise(0.0)
    score = F.round(score, 4)
    return df.withColumn("score", score).withColumn("status", F.when(score >= 0.8, "validated").when(score >= 0.5, "partial").otherwise("incomplete"))


def lifecycle(text: Column, superseded_by: Column, version: Column, review: Column, as_of: Column) -> Column:

    def named(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for stage, words in L.LIFECYCLE.items():
            out = out.when(any_of(low, words), stage)
        return out

    said = let(F.lower(F.coalesce(text, F.lit(""))), named)
    return F.when(said.isNotNull(), said).when(filled(superseded_by), "obsolete").when(F.lower(F.coalesce(version, F.lit(""))).contains("draft"), "draft").when(review > as_of, "active").otherwise("unknown")


def references(df: DataFrame) -> DataFrame:
    """(document_code, relation, reference) edges, each once."""
    kinds = [("supersedes", F.col("supersedes")), ("related", F.col("related_documents")), ("superseded_by", F.array_compact(F.array("superseded_by")))]
    parts = [df.select("document_code", F.lit(name).alias("relation"), F.explode(c).alias("reference")) for name, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("document_code IS NOT NULL AND reference IS NOT NULL AND reference <> ''").distinct()


def known_references(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges whose reference is a registered code. A code that many edges share is split by the adaptive skew join."""
    return edges.join(registry.select(F.col("document_code").alias("reference")).distinct(), "reference", "left_semi").select(edges.columns)


def compliance_edges(df: DataFrame) -> DataFrame:
    return df.select("document_id", F.explode("compliance_mappings").alias("framework", "requirements")).select("document_id", "framework", F.explode("requirements").alias("requirement")).distinct()


def confidence(text: Column, errors: Column, tables: Column) -> Column:
    """Confidence in a parsed text: errors, shortness, few letters and no common words lower it, tables raise it."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    s = F.lit(1.0) - 0.1 * F.coalesce(F.size(errors), F.lit(0))
    s = s - F.when(n < 100, 0.3).when(n < 500, 0.1).otherwise(0.0)
    s = s + F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, 0.1).otherwise(0.0)
    s = s - F.when((n > 0) & (letters / n < 0.5), 0.2).otherwise(0.0)
    s = s - F.when(let(F.lower(t), lambda x: hits(x, L.SANITY_WORDS)) < 3, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def parsing_report(df: DataFrame) -> DataFrame:
    """Per document type: documents, those without errors, messages, mean confidence."""
    bad = F.coalesce(F.size("parsing_errors"), F.lit(0))
    kind = F.coalesce(F.lower(F.trim("doc_type")), F.lit("unknown"))
    return df.groupBy(kind.alias("doc_type")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(bad == 0).alias("without_errors"), F.sum(F.greatest(bad, F.lit(0))).cast("bigint").alias("messages"), F.round(F.avg("confidence_score"), 4).alias("mean_confidence")
    )
