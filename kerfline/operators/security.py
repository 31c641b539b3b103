"""Security context of documents, question-answer quality, table kinds, question intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, best_of, first_of, hits, let, words


def _lower(table: dict[str, list[str]]) -> dict[str, list[str]]:
    return {k: [w.lower() for w in v] for k, v in table.items()}


def named(lowered: Column, table: dict[str, list[str]]) -> Column:
    """The labels of which a word occurs, in alphabetical order; ``lowered`` is a column that holds the text in lower case."""
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(lowered, w), F.lit(k)) for k, w in _lower(table).items()])))


def context(df: DataFrame, key: str, text: str) -> DataFrame:
    """Frameworks, domains, risk levels, roles, vulnerability ids, kind, importance and criticality of each text."""
    # lowered once, in a projection of its own: an expression that is used many times isn't merged into the next one
    rest = [c for c in df.columns if c not in (key, text)]
    df, low = df.select(key, text, *rest, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low")), F.col("_low")
    x = df.select(
        key,
        *rest,
        named(low, L.FRAMEWORK_VARIANTS).alias("frameworks"),
        named(low, L.SECURITY_DOMAINS).alias("domains"),
        named(low, L.RISK_LEVELS).alias("risks"),
        named(low, L.SECURITY_ROLES).alias("roles"),
        F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("CVE-[0-9]{4}-[0-9]{4,7}"), F.lit(0))).alias("vulnerabilities"),
        any_of(low, L.REQUIREMENT_WORDS).alias("requires"),
        first_of(low, L.SECURITY_DOCUMENT_TYPES, "other").alias("security_kind"),
    )
    score = 2 * F.size("frameworks") + F.when(F.col("requires"), 3).otherwise(0)
    score = score + F.when(F.array_contains("risks", "Critique"), 5).when(F.array_contains("risks", "Élevé"), 3).otherwise(0)
    score = score + F.when(F.array_contains("roles", "RSSI") | F.array_contains("roles", "DPO"), 2).otherwise(0)
    critical = (score >= 7) | F.array_contains("risks", "Critique") | (F.col("vulnerabilities") > 0)
    return x.withColumn("importance", F.least(F.lit(10), score)).withColumn("is_critical", critical)


def domain_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, domain, hits) of the domains that a text touches."""
    n = F.array(*[F.struct(F.lit(k).alias("domain"), hits(F.col("_low"), w).alias("hits")) for k, w in _lower(L.SECURITY_DOMAINS).items()])
    return df.where(F.col(text).isNotNull()).select(key, F.lower(F.col(text)).alias("_low")).select(key, F.explode(F.filter(n, lambda s: s["hits"] > 0)).alias("s")).select(key, "s.domain", "s.hits")


def pair_confidence(question: Column, answer: Column) -> Column:
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    n, shared = F.size(words(a)), F.size(F.array_intersect(words(F.lower(q)), words(F.lower(a))))
    s = F.lit(1.0) - F.when(~q.endswith("?") & ~any_of(F.lower(q), ["comment", "pourquoi", "what", "how"]), 0.2).otherwise(0.0)
    s = s - F.when(n < 5, 0.3).when(n > 500, 0.1).otherwise(0.0) - F.when(shared < 2, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def topics(text: Column, most: int = 5) -> Column:
    found = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*[F.when(any_of(low, w), F.lit(k)) for k, w in L.TOPICS.items()]))
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, most)


def table_kind(data: Column) -> Column:
    """Kind of a table by its first row with content: two or more headers must point to it."""
    head = F.transform(F.get(F.filter(data, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != "")), F.lit(0)), lambda c: F.lower(F.coalesce(c, F.lit(""))))
    scores = [(k, F.coalesce(F.size(F.filter(head, lambda c: c.rlike(L.SHEET_HEADERS[k]))), F.lit(0))) for k in L.SHEET_HEADERS]
    return best_of([(k, F.when(s >= 2, s).otherwise(0)) for k, s in scores], "generic")


def status(cell: Column) -> Column:
    out = F.when(F.lower(cell).rlike(L.STATUS["compliant"]), "compliant")
    for k in list(L.STATUS)[1:]:
        out = out.when(F.lower(cell).rlike(L.STATUS[k]), k)
    return out.otherwise("non_défini")


def intent(query: Column) -> Column:
    """The last intent of which a pattern matches, as the later ones are the more specific."""
    low, out = F.lower(query), F.lit("general")
    for name, patterns in L.QUESTION_INTENTS.items():
        out = F.when(low.rlike("|".join(patterns)), name).otherwise(out)
    return out
