"""Coverage of a question by its refined strips, the decision for more, and elements of an answer.

Rows are the refined strips of (question key): query, content, strip_type, score, place. Everything about
a question is one aggregation by its key over at most ten strips, so groups are bounded.

Defined results: a question without strips has no row; a null content counts as empty; needs of a
question without a known intent are none, and its coverage then rests on the number and scores of strips.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.functions.text import any_of

# What a question of each intent needs, and what shows that a need is met.
ESSENTIAL = {"comment_fonctionne": ["explication_mécanisme", "description_architecture"], "qu_est_ce_que": ["définition_claire"], "pourquoi": ["justification"]}
OPTIONAL = {"comment_fonctionne": ["exemple_concret"], "qu_est_ce_que": ["caractéristiques", "exemple_concret"], "pourquoi": ["avantages"]}
NEEDS = {
    "explication_mécanisme": (["mécanisme", "utilise", "permet", "fonctionne", "calcule", "traite", "processus"], r"est le.*clé", []),
    "description_architecture": (["architecture", "structure", "composant", "couche", "module", "élément"], r"-\s+[\p{L}\p{N}_]|composé.*de|inclut", ["enumeration"]),
    "définition_claire": (["est un", "sont des", "représente", "consiste"], None, ["definition"]),
    "exemple_concret": (["exemple", "comme", "bert", "gpt", "tel que"], "t5", []),
    "caractéristiques": (["caractéristiques"], None, []),
    "justification": (["justification"], None, []),
    "avantages": (["avantages"], None, []),
}
NO_CONCEPTS = ["le", "la", "les", "un", "une", "des", "de", "?", "comment", "qu'est-ce"]
DETAIL_WORDS = ["permet", "calcule", "traite", "capture"]
REASON_WORDS = ["révolutionnaire", "transformé", "important", "essentiel"]
GAIN_WORDS = ["avantage", "permet", "facilite", "améliore", "efficace"]
MECHANISMS = (r"utilise[nt]?\s+([^.]+)", r"emploie[nt]?\s+([^.]+)", r"mécanisme\s+(?:de\s+)?([^.]+)")
KEY_WORDS = ["clé", "principal", "important"]


def question_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(NO_CONCEPTS))


def _met(need: str, low: Column, strip_type: Column) -> Column:
    words, pattern, types = NEEDS[need]
    out = any_of(low, words)
    if pattern:
        out = out | low.rlike(pattern)
    return out | strip_type.isin(types) if types else out


def needs_of(intent: Column, table: dict[str, list[str]]) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, needs in table.items():
        out = out.when(intent == name, F.array(*[F.lit(n) for n in needs]))
    return out.otherwise(F.array().cast("array<string>"))


def coverage(strips: DataFrame, key: str, intent: Column, enough: float = 0.6) -> DataFrame:
    """(key, intent, n, covered, missing, coverage, needs_more, summary).

    coverage: share of the essential needs met (without any: 0.8 for three strips and one above 0.7, else 0.5), a
    fifth more for three strips of 0.7, then 0.7 of that and 0.3 of the share of the question's words found.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    x = strips.select(key, "score", intent.alias("intent"), low.alias("_low"), F.col("strip_type"), question_words(F.col("query")).alias("_words"))
    x = x.withColumn("_found", F.filter("_words", lambda w: F.contains(F.col("_low"), w)))
    g = x.groupBy(key).agg(
        F.first("intent").alias("intent"), F.first("_words").alias("_words"), F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.7).alias("_good"), F.max("score").alias("_top"), *[F.bool_or(_met(need, F.col("_low"), F.coalesce("strip_type", F.lit("")))).alias(f"_{k}") for k, need in enumerate(NEEDS)],
    )
    met = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(need)) for k, need in enumerate(NEEDS)]))
    g = g.withColumn("_met", met).withColumn("_need", needs_of(F.col("intent"), ESSENTIAL)).withColumn("_may", needs_of(F.col("intent"), OPTIONAL))
    covered = F.array_intersect(F.concat("_need", "_may"), F.col("_met"))
    g = g.withColumn("covered", covered).withColumn("missing", F.array_except("_need", "_met"))
    total = F.size("_need")
    base = F.when(total > 0, (total - F.size("missing")) / total).when((F.col("n") >= 3) & (F.col("_top") > 0.7), 0.8).otherwise(0.5)
    g = g.withColumn("_base", F.when(F.col("_good") >= 3, F.least(F.lit(1.0), base * 1.2)).otherwise(base))
    words = F.size("_words")
    found = F.size(F.filter("_words", lambda w: F.array_contains(F.col("_found"), w)))
    g = g.withColumn("coverage", F.when(words > 0, F.col("_base") * 0.7 + found / words * 0.3).otherwise(F.col("_base")))
    half = (total > 0) & (F.size("missing") <= total / 2)
    more = ~((F.col("coverage") >= 0.8) | (F.col("_good") >= 4) | half) & ((F.col("n") < 3) | (F.col("coverage") < enough))
    g = g.withColumn("needs_more", more)
    summary = F.concat_ws(" | ", F.format_string("%d strips", F.col("n")), F.format_string("couverture %d %%", F.round(F.col("coverage") * 100).cast("int")), F.when(F.size("covered") > 0, F.array_join("covered", ", ")), F.when(F.col("needs_more"), "info supplémentaire utile").otherwise("info suffisante"))
    return g.select(key, "intent", "n", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), F.round("coverage", 6).alias("coverage"), "needs_more", summary.alias("summary"))


def first_sentence(text: Column) -> Column:
    return F.concat(F.element_at(F.split(text, r"\."), 1), F.lit("."))


def shortened(text: Column, words: int) -> Column:
    """The first ``words`` words and three dots, or the text if it has no more."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) <= words, text).otherwise(F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("...")))


def subject(definition: Column) -> Column:
    """What stands before the first ``est`` or ``sont``, else the first three words."""
    before = F.regexp_extract(definition, r"([\p{L}\p{N}_\s]+)\s+(?:est|sont)", 1)
    return F.when(before != "", F.regexp_replace(before, r"^\s+|\s+$", "")).otherwise(F.array_join(F.slice(F.filter(F.split(definition, r"\s+"), lambda x: x != ""), 1, 3), " "))


def key_mechanism(text: Column) -> Column:
    low = F.lower(text)
    found = [F.regexp_extract(low, p, 1) for p in MECHANISMS]
    out = reduce(lambda w, f: w.when(f != "", f), found[1:], F.when(found[0] != "", found[0]))
    return F.regexp_replace(out.otherwise("leur mécanisme spécifique"), r"^\s+|\s+$", "")


def element(content: Column, strip_type: Column) -> Column:
    """The one part of an answer that a strip can give."""
    low = F.lower(content)
    return (
        F.when(strip_type == "definition", "definition")
        .when(any_of(low, ["mécanisme", "utilise"]), "mechanism")
        .when((strip_type == "enumeration") | content.contains("- "), "components")
        .when(any_of(low, ["bert", "gpt", "exemple"]), "example")
        .when(any_of(low, DETAIL_WORDS), "details")
        .when(any_of(low, REASON_WORDS), "reason")
        .when(any_of(low, GAIN_WORDS), "gains")
    )


def key_point(content: Column) -> Column:
    """The first sentence that speaks of something key or principal, in a strip that speaks of something important."""
    point = F.get(F.filter(F.split(content, r"\."), lambda s: any_of(F.lower(s), KEY_WORDS[:2])), F.lit(0))
    return F.when(any_of(F.lower(content), KEY_WORDS), F.concat(F.regexp_replace(point, r"^\s+|\s+$", ""), F.lit(".")))


def elements(strips: DataFrame, key: str) -> DataFrame:
    """Parts of an answer: the first strip of each part (of components the last), all details, three key points of the first five strips."""
    c = F.coalesce("content", F.lit(""))
    x = strips.select(key, "place", c.alias("content"), element(c, F.coalesce("strip_type", F.lit(""))).alias("_part"), F.when(F.col("place") <= 5, key_point(c)).alias("_point"))
    one = lambda part, pick: pick(F.when(F.col("_part") == part, F.col("content")), F.when(F.col("_part") == part, F.col("place")))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("place").alias("p"), value.alias("v"))))), lambda s: s["v"])
    g = x.groupBy(key).agg(
        *[one(p, F.min_by).alias(p) for p in ("definition", "mechanism", "example", "reason", "gains")], one("components", F.max_by).alias("components"),
        F.array_join(ordered(F.when(F.col("_part") == "details", F.col("content"))), "\n\n").alias("details"), F.array_join(F.slice(ordered(F.col("_point")), 1, 3), "\n").alias("key_points"),
    )
    return g.withColumns({
        "short_definition": first_sentence(F.col("definition")), "short_mechanism": shortened(F.col("mechanism"), 50), "short_example": first_sentence(F.col("example")),
        "subject": subject(F.col("definition")), "key_mechanism": key_mechanism(F.col("mechanism")),
    })


def answer(parts: DataFrame, key: str) -> DataFrame:
    """(key, answer): the parts that there are, in the order of an answer; without any, nothing."""
    named = [("definition", ""), ("mechanism", "Fonctionnement : "), ("details", ""), ("components", ""), ("example", "Exemple : "), ("reason", ""), ("gains", "")]
    text = F.concat_ws("\n\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c)) for c, lead in named])
    return parts.select(key, text.alias("answer"))
