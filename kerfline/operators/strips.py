"""Domain features of knowledge strips: category, references, obligation, authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, best_of, first_of, hits, let, present


def category(text: Column) -> Column:
    return let(F.lower(text), category_of)


def category_of(low: Column) -> Column:
    """The category of a text in lower case."""
    return best_of([(name, hits(low, words, weight)) for name, weight, words in L.CATEGORIES], "general")


def compliance_references(text: Column) -> Column:
    return let(F.upper(text), lambda up: F.array_sort(F.filter(F.array(*[F.lit(f) for f in L.FRAMEWORKS]), lambda f: up.contains(F.upper(f)))))


def control_types(text: Column) -> Column:
    return let(F.lower(text), control_types_of)


def control_types_of(low: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in L.CONTROL_TYPES.items()])))


def obligation(text: Column) -> Column:
    return let(F.lower(text), lambda low: first_of(low, L.OBLIGATIONS, "informational"))


def authority(doc_type: Column) -> Column:
    out = F.when(doc_type == "policy", L.AUTHORITY["policy"])
    for name, value in L.AUTHORITY.items():
        out = out.when(doc_type == name, value)
    return out.otherwise(L.AUTHORITY["general"])


def _count(found: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(found, lambda c: c.isin(wanted)))


def mapped_controls(text: Column) -> Column:
    """min(.15, .05 for every control of the first framework that meets a counterpart of it in the text)."""
    iso = F.regexp_extract_all(text, F.lit(r"A\.[0-9]+(?:\.[0-9]+)?"), 0)
    other = F.concat(F.regexp_extract_all(text, F.lit(r"[A-Z]{2}-[0-9]+"), 0), F.regexp_extract_all(text, F.lit(r"CIS\s+[0-9]+"), 0))

    def bonus(found: Column) -> Column:
        pairs = F.lit(0)
        for control, partners in L.CONTROL_MAPPING.items():
            pairs = pairs + _count(found["iso"], [control]) * _count(found["other"], partners)
        return F.least(F.lit(0.15), F.lit(0.05) * pairs)

    return let(F.struct(iso.alias("iso"), other.alias("other")), bonus)


def signature(text: Column) -> Column:
    """The five longest words of four letters or more (the earlier of equal length), in alphabetical order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{4,}"), 0)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, 5), lambda s: s["w"])), " ")


def audit_context(query: Column) -> Column:
    """The context with the most matching patterns, the first of equals; otherwise general."""

    def matches(low: Column, patterns: list[str]) -> Column:
        n = F.lit(0)
        for p in patterns:
            n = n + low.rlike(p).cast("int")
        return n

    return let(F.lower(query), lambda low: best_of([(name, matches(low, patterns)) for name, patterns in L.CONTEXT_PATTERNS.items()], "compliance_general"))


def audit_bonus(context: Column, doc_type: Column, official: Column, text: Column, base: Column) -> Column:
    """The base score weighted by source, plus required and preferred elements, authority and mapped controls, within [0, 1]."""
    mapped = mapped_controls(text)
    return let(F.lower(text), lambda low: _audit_score(context, doc_type, official, low, mapped, base))


def _audit_score(context: Column, doc_type: Column, official: Column, low: Column, mapped: Column, base: Column) -> Column:
    out = F.when(context == "compliance_general", base)
    for name, required, preferred, weights, formal in L.AUDIT_RULES:
        weight = F.when(F.lit(False), F.lit(1.0))
        for kind, value in weights.items():
            weight = weight.when(doc_type == kind, value)
        score = base * weight.otherwise(1.0) + F.least(F.lit(0.2), 0.05 * hits(low, required)) + F.least(F.lit(0.1), 0.02 * hits(low, preferred))
        if formal:
            score = score + F.when(F.coalesce(official, F.lit(False)), 0.1).otherwise(0.0)
        if name in ("iso_27001", "rgpd_gdpr"):
            score = score + mapped
        out = out.when(context == name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.otherwise(base)


def missing_elements(text: Column, words: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(w) for w in words]), present(F.lower(text), words))
