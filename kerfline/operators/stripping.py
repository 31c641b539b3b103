"""Cutting documents into knowledge strips by their type.

Every cutter takes rows of (key, text) and works on each row's own array of lines or
sentences, so nothing is shuffled. A cutter gives (key, position, strip_type, content) and
what it knows beside.

Defined results: null and blank texts have no strips; texts are used whole; a text in which a
cutter finds no mark of its own comes out as one strip (policies, procedures) or as its
paragraphs (question lists); extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, first_of, let
from kerfline.operators import strips

#: The outer forms of explode are used on derived arrays: the plain ones make Spark infer a filter on the array, which
#: is pushed below the projections and evaluates what they hold once for every element.
EDGES = r"^\s+|\s+$"
# How sections, statements, parts, steps, actors and questions are marked.
SECTION_MARK = r"^(?:[0-9]+\.[0-9]*\s*|[A-Z]\.\s*|Article\s+[0-9]+|Annexe\s+|Appendice\s+)"
STATEMENTS = (
    r"(?:^|\n)(?:[0-9]+\.?\s*)?(?:Il est |L'organisation |La société |Nous |Le personnel ).*?(?:doit|doivent|ne doit pas|ne doivent pas).*?(?:\.|;|\n\n)",
    r"(?:^|\n)(?:[0-9]+\.?\s*)?Tout.*?(?:doit|doivent|est|sont).*?(?:\.|;|\n\n)",
    r"(?:^|\n)(?:[0-9]+\.?\s*)?[\p{L}\p{N}_]+.*?(?:shall|must|shall not|must not).*?(?:\.|;|\n\n)",
)
#: A word of each list is in every match of the statement in the same place.
MUST_HOLD = (["doit", "doivent", "ne doit pas", "ne doivent pas"], ["Tout"], ["shall", "must"])
PARTS = {"objective": "objectif|but|purpose|scope", "prerequisites": "prérequis|pré-requis|prerequisites|conditions", "steps": "étapes|procédure|steps|process", "responsibilities": "responsabilit|raci|roles"}
STEPS = (
    r"(?:Étape|Step)\s+([0-9]+)\s*[:\-.]?\s*(.+?)(?=(?:Étape|Step)\s+[0-9]+|$)",
    r"([0-9]+)\.\s+(.+?)(?=[0-9]+\.|$)",
    r"([a-z])\)\s+(.+?)(?=[a-z]\)|$)",
)
ACTORS = (
    (r"(?:Le |La |L')([\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+)?)\s+(?:doit|peut|vérifie|approuve|valide)", 1),
    (r"RSSI|DSI|DPO|administrateur|utilisateur|responsable|manager|auditeur", 0),
    (r"security officer|admin|user|manager|auditor", 0),
)
PAIRS = (
    r"(?:Q|Question)\s*[:.]?\s*(.+?)(?:\n|$).*?(?:R|A|Réponse|Answer)\s*[:.]?\s*(.+?)(?=(?:Q|Question)|$)",
    r"^\s*[0-9]+\.\s*(.+?)\n+(.+?)(?=^\s*[0-9]+\.|$)",
    r"^#{1,3}\s*(.+?)\n+(.+?)(?=^#{1,3}|$)",
)
#: Category of a sentence -> (strip type, most sentences that may follow it, words that make one follow, bullets that do, joint).
FOLLOWERS = {
    "policy": ("policy_statement", 2, ["cela", "cette mesure", "cette politique", "ce qui", "en particulier", "notamment", "incluant", "y compris"], None, " "),
    "control": ("control_measure", 3, ["configuration", "paramètre", "setting", "mise en œuvre", "implementation", "déploiement", "deployment"], r"^\s*[-•]", " "),
    "compliance": ("compliance_requirement", 2, ["pour satisfaire", "afin de", "cela implique", "nécessite", "to comply", "this requires", "implementation"], None, " "),
    "procedure": ("procedure_step", 4, ["ensuite", "puis", "après", "then", "next"], r"^\s*(?:[a-z]\)|[-•])", "\n"),
}
DEFINITION = r"(?:est|sont)\s+(?:un|une|des|le|la|les)|se définit comme|consiste à|représente|qu'on appelle"
EXAMPLE = r"par exemple|comme|tel(?:s)?\s+que|notamment|illustration"
GOES_ON = r"^(?:il|elle|ils|elles|cela|ce|cette|ces|it|they|this|these)(?:[^\p{L}]|$)"
ENUMERATION = r"^\s*[-•*0-9]+[\s.)]"
FLAGS = "(?smd)"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def sentences_of(text: Column) -> Column:
    """Cut after . ! ? before a blank, and at line ends, so that bullets stand alone."""
    s = F.split(F.regexp_replace(text, r"([.!?])\s+|\n+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(s, trim), lambda x: x != "")


def spans(starts: Column, size: Column) -> Column:
    """array<struct<from, n>> of the stretches that begin at ``starts``."""
    return F.transform(starts, lambda s, i: F.struct(s.alias("from"), (F.coalesce(F.get(starts, i + 1), size) - s).alias("n")))


def section_level(line: Column) -> Column:
    return (
        F.when(line.rlike("^[0-9]"), F.length(line) - F.length(F.replace(line, F.lit("."), F.lit(""))) + 1)
        .when(line.startswith("#"), F.length(line) - F.length(F.regexp_replace(line, "^#+", "")))
        .when(line.startswith("Article"), 1)
        .when(line.startswith("Section"), 2)
        .otherwise(0)
    )


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, header, level, content); lines before the first mark make a section without a header."""
    x = df.where(F.col(text).isNotNull()).select(key, F.filter(F.split(F.col(text), "\n"), lambda v: trim(v) != "").alias("_lines")).where(F.size("_lines") > 0)
    x = x.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | trim(F.get("_lines", i)).rlike(SECTION_MARK)))
    x = x.select(key, "_lines", F.posexplode_outer(spans(F.col("_starts"), F.size("_lines"))).alias("position", "_s")).where("position IS NOT NULL")
    first = trim(F.get("_lines", F.col("_s.from")))
    x = x.select(key, "position", first.alias("_first"), trim(F.array_join(F.slice("_lines", F.col("_s.from") + 1, F.col("_s.n")), "\n")).alias("content"))
    marked = F.col("_first").rlike(SECTION_MARK)
    return x.select(key, "position", F.when(marked, F.col("_first")).otherwise("").alias("header"), F.when(marked, section_level(F.col("_first"))).otherwise(0).alias("level"), "content")


def statements(content: Column) -> Column:
    """Statements of a policy of five words or more, by pattern; the whole content where there is none."""
    none = F.array().cast("array<string>")
    # a pattern without its words can't match, and would search to the end from every line
    found = F.flatten(F.array(*[F.when(any_of(content, words), F.regexp_extract_all(content, F.lit(FLAGS + p), F.lit(0))).otherwise(none) for p, words in zip(STATEMENTS, MUST_HOLD, strict=True)]))
    kept = F.filter(F.transform(found, trim), lambda s: F.size(F.split(s, r"\s+")) >= 5)
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(content)))


def policy_strips(df: DataFrame, key: str, text: str) -> DataFrame:
    """A strip per statement (position: section * 100 + number) where a section has several, else the section."""
    x = sections(df, key, text).withColumn("_all", statements(F.col("content")))
    many = F.size("_all") > 1
    x = x.select(key, "position", many.alias("_many"), F.posexplode_outer(F.when(many, F.col("_all")).otherwise(F.array("content"))).alias("_j", "content"))
    return x.select(
        key, F.when(F.col("_many"), F.col("position") * 100 + F.col("_j")).otherwise(F.col("position")).alias("position"),
        F.when(F.col("_many"), "policy_statement").otherwise("policy_section").alias("strip_type"), "content", F.lit("policy").alias("category"),
    )


def steps(content: Column) -> Column:
    """array<struct<number, content>> by the first way of numbering that occurs; one step where none does."""
    found = [F.arrays_zip(F.regexp_extract_all(content, F.lit(FLAGS + p), F.lit(1)).alias("number"), F.transform(F.regexp_extract_all(content, F.lit(FLAGS + p), F.lit(2)), trim).alias("content")) for p in STEPS]
    out = F.when(F.size(found[0]) > 0, found[0])
    for f in found[1:]:
        out = out.when(F.size(f) > 0, f)
    return out.otherwise(F.array(F.struct(F.lit("1").alias("number"), content.alias("content"))))


def actors(content: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit("(?i)" + p), F.lit(g)) for p, g in ACTORS]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda a: (a != "") & ~F.lower(a).isin("le", "la", "l'"))))


def topics(text: Column) -> Column:
    """Frameworks, kinds of control and the first kind of risk named, at most five in alphabetical order."""
    low = F.lower(text)
    found = [F.when(low.contains(f.lower()), F.lit(f"compliance:{f}")) for f in L.FRAMEWORKS] + [F.when(any_of(low, w[:3]), F.lit(f"control:{k}")) for k, w in L.CONTROL_TYPES.items()]
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), 1, 5)


def procedure_strips(df: DataFrame, key: str, text: str) -> DataFrame:
    """Parts of a procedure by the words that open them; the part of the steps is cut into its steps."""
    x = df.where(F.col(text).isNotNull() & (trim(F.col(text)) != "")).select(key, F.split(F.col(text), "\n").alias("_lines"))
    kind = lambda v: reduce(lambda w, p: w.when(F.lower(v).rlike(p[1]), p[0]), list(PARTS.items())[1:], F.when(F.lower(v).rlike(next(iter(PARTS.values()))), next(iter(PARTS))))
    x = x.withColumn("_kinds", F.transform("_lines", kind))
    x = x.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | F.get("_kinds", i).isNotNull()))
    x = x.select(key, "_lines", "_kinds", F.posexplode_outer(spans(F.col("_starts"), F.size("_lines"))).alias("part", "_s")).where("part IS NOT NULL")
    of = F.when(F.col("_s.from") == 0, "general").otherwise(F.get("_kinds", F.col("_s.from")))
    x = x.select(key, "part", of.alias("_of"), F.array_join(F.slice("_lines", F.col("_s.from") + 1, F.col("_s.n")), "\n").alias("_text"))
    is_steps = F.col("_of") == "steps"
    x = x.select(key, "part", "_of", F.posexplode_outer(F.when(is_steps, steps(F.col("_text"))).otherwise(F.array(F.struct(F.lit("").alias("number"), F.col("_text").alias("content"))))).alias("_j", "_p"))
    return x.select(
        key, F.when(is_steps, F.col("part") * 100 + F.col("_j")).otherwise(F.col("part")).alias("position"), F.when(is_steps, "procedure_step").otherwise(F.concat(F.lit("procedure_"), "_of")).alias("strip_type"),
        F.col("_p.content").alias("content"), F.lit("procedure").alias("category"), F.col("_p.number").alias("step"), F.when(is_steps, F.col("_p.content").rlike(r"[a-z]\)")).otherwise(False).alias("has_substeps"), actors(F.col("_p.content")).alias("actors"),
    )


def faq_strips(df: DataFrame, key: str, text: str) -> DataFrame:
    """A strip per question and answer, by the first way of writing them that occurs; else the paragraphs."""
    c = F.col(text)
    pair = [F.arrays_zip(*[F.transform(F.regexp_extract_all(c, F.lit(FLAGS + p), F.lit(g)), trim).alias(n) for g, n in ((1, "q"), (2, "a"))]) for p in PAIRS]
    text_of = lambda x: F.concat(F.lit("Question: "), x["q"], F.lit("\n\nRéponse: "), x["a"])
    out = F.when(F.size(pair[0]) > 0, F.transform(pair[0], text_of))
    for p in pair[1:]:
        out = out.when(F.size(p) > 0, F.transform(p, text_of))
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), trim), lambda x: x != "")
    x = df.where(c.isNotNull()).select(key, out.alias("_pairs"), paragraphs.alias("_rest"))
    x = x.select(key, F.when(F.col("_pairs").isNull(), "faq_content").otherwise("faq_entry").alias("strip_type"), F.posexplode_outer(F.coalesce("_pairs", "_rest")).alias("position", "content")).where("position IS NOT NULL")
    return x.select(key, "position", "strip_type", "content", F.lit("faq").alias("category"), topics(F.col("content")).alias("topics"))


def _follows(s: Column, low: Column, category: str) -> Column:
    _, _, words, bullet, _ = FOLLOWERS[category]
    hit = any_of(low, words)
    return hit | s.rlike(bullet) if bullet else hit


def adaptive_strips(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences; one of a known category takes along the next few that go on with it, in one pass from the first.

    A definition takes along two sentences that begin with a pronoun, an enumeration all items that follow.
    position: number of the first sentence; merged: how many sentences.
    """
    names = list(FOLLOWERS)
    x = df.where(F.col(text).isNotNull()).select(key, sentences_of(F.col(text)).alias("_s")).where(F.size("_s") > 0)

    # step by step, as expressions within a lambda are evaluated each time they occur
    x = x.withColumn("_l", F.transform("_s", lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"))))
    x = x.withColumn("_l", F.transform("_l", lambda v: F.struct(v["s"].alias("s"), v["low"].alias("low"), strips.category_of(v["low"]).alias("category"))))

    def features(v: Column) -> Column:
        s, low, category = v["s"], v["low"], v["category"]
        kind = F.when(~category.isin("general", "audit"), category).when(low.rlike(DEFINITION), "definition").when(low.rlike(EXAMPLE), "example").when(s.rlike(ENUMERATION), "enumeration").otherwise("statement")
        return F.struct(category.alias("category"), kind.alias("kind"), s.rlike(ENUMERATION).alias("item"), low.rlike(GOES_ON).alias("definition"), *[_follows(s, low, c).alias(c) for c in names])

    x = x.withColumn("_f", F.transform("_l", features))

    def length(f: Column, i: Column) -> Column:
        out = F.when(F.lit(False), F.lit(1))
        for c, most in [*((c, FOLLOWERS[c][1]) for c in names), ("definition", 2)]:
            run = F.lit(1 + most)
            for k in range(most, 0, -1):
                run = F.when(~F.coalesce(F.get("_f", i + k)[c], F.lit(False)), k).otherwise(run)
            out = out.when(f["kind"] == c, run)
        return out.otherwise(1)

    x = x.withColumn("_n", F.transform("_f", length))

    def walk(a: Column, i: Column) -> Column:
        f = F.get("_f", i)
        taken = (i < a["next"]) | (a["items"] & f["item"])
        begun = F.struct((i + F.get("_n", i)).alias("next"), (f["kind"] == "enumeration").alias("items"), F.array_append(a["starts"], i).alias("starts"))
        return F.when(taken, a).otherwise(begun)

    begin = F.struct(F.lit(0).alias("next"), F.lit(False).alias("items"), F.array().cast("array<int>").alias("starts"))
    x = x.withColumn("_starts", F.aggregate(F.sequence(F.lit(0), F.size("_n") - 1), begin, walk)["starts"])
    x = x.select(key, "_s", "_f", F.explode_outer(spans(F.col("_starts"), F.size("_s"))).alias("_p")).where("_p IS NOT NULL")
    first = F.get("_f", F.col("_p.from"))
    x = x.select(key, F.col("_p.from").alias("position"), F.col("_p.n").alias("merged"), first["category"].alias("category"), first["kind"].alias("_kind"), F.slice("_s", F.col("_p.from") + 1, F.col("_p.n")).alias("_s"))
    bullet = lambda s: s.rlike(FOLLOWERS["control"][3]) & ~any_of(F.lower(s), FOLLOWERS["control"][2])
    bulleted = F.aggregate(F.slice("_s", 2, F.size("_s")), F.get("_s", F.lit(0)), lambda a, s: F.concat(a, F.when(bullet(s), "\n").otherwise(" "), s))
    content = F.when(F.col("_kind") == "control", bulleted).when(F.col("_kind").isin("procedure", "enumeration"), F.array_join("_s", "\n")).otherwise(F.array_join("_s", " "))
    kind = F.when(F.col("_kind") == "risk", "risk_statement")
    for c in names:
        kind = kind.when(F.col("_kind") == c, FOLLOWERS[c][0])
    return x.select(key, "position", kind.otherwise(F.col("_kind")).alias("strip_type"), content.alias("content"), "category", "merged")


def document_kind(text: Column) -> Column:
    """The kind that decides how a document is cut, by phrases in its first 1,000 characters."""
    return let(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 1000)), lambda x: first_of(x, L.STRIP_DOCUMENT_TYPES, "general"))


def strip_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, strip_type, content, category, refs, obligation, is_requirement, is_critical) of documents of all kinds."""
    x = df.select(key, F.col(text).alias("_t"), document_kind(F.col(text)).alias("_kind"))
    cutters = (("policy", policy_strips), ("procedure", procedure_strips), ("faq", faq_strips))
    parts = [cut(x.where(F.col("_kind") == kind), key, "_t") for kind, cut in cutters] + [adaptive_strips(x.where(~F.col("_kind").isin([k for k, _ in cutters])), key, "_t")]
    out = reduce(DataFrame.unionByName, [p.select(key, "position", "strip_type", "content", "category") for p in parts])
    c = F.col("content")
    return out.select(
        key, "position", "strip_type", "content", F.when(F.col("category") != "general", F.col("category")).otherwise(strips.category(c)).alias("category"), strips.compliance_references(c).alias("refs"), strips.obligation(c).alias("obligation"),
        let(F.lower(c), lambda v: any_of(v, L.REQUIREMENT_WORDS)).alias("is_requirement"), let(F.lower(c), lambda v: any_of(v, L.CRITICAL_WORDS)).alias("is_critical"),
    )
