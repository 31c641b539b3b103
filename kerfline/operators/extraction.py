"""Metadata that stands in the texts themselves: codes, dates, people, classification, organisation, relations, sensitive data.

All are expressions over a text column, table-driven: for each field the patterns are tried in order and the
first that fits gives the value. Whole texts are searched.

Defined results: a null text has no value in any field (the version is then 1.0, as where none is named);
repeated mentions of a relation are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

A, Z = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
DAY = r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
NAME = r"([A-Za-zÀ-ÿ \t.-]+)"
REF = r"([A-Z0-9.-]+)"
# How a document names its fields.
CODES = [rf"{A}((?:POL|PROC|STD|GUI|REF|FORM)-[A-Z]{{2,}}-[0-9]{{3,}}){Z}", rf"{A}([A-Z]{{2,}}-[0-9]{{4}}-[0-9]{{2}}){Z}", rf"(?i){A}Document\s*(?:Code|Ref|#)\s*:\s*{REF}", rf"(?i){A}Référence\s*:\s*{REF}"]
VERSIONS = [rf"(?i){A}Version\s*:?\s*([0-9]+(?:\.[0-9]+)*){Z}", rf"{A}V([0-9]+(?:\.[0-9]+)*){Z}", rf"(?i){A}Rev(?:ision)?\s*:?\s*([0-9]+(?:\.[0-9]+)*){Z}", rf"(?i){A}([0-9]+(?:\.[0-9]+)*)\s*\|\s*(?:Draft|Final|Approved){Z}"]
DATES = {
    "creation": [rf"(?i)(?:Créé|Created|Établi)\s*(?:le|on)?\s*:?\s*{DAY}", rf"(?i)Date\s*de\s*création\s*:?\s*{DAY}"],
    "modification": [rf"(?i)(?:Modifié|Modified|Mis à jour)\s*(?:le|on)?\s*:?\s*{DAY}", rf"(?i)Dernière\s*modification\s*:?\s*{DAY}"],
    "review": [rf"(?i)(?:Revu|Reviewed|À revoir)\s*(?:le|on|avant)?\s*:?\s*{DAY}", rf"(?i)Prochaine\s*(?:revue|révision)\s*:?\s*{DAY}", rf"(?i)revue du\s*{DAY}"],
    "expiry": [rf"(?i)(?:Expire|Valide jusqu'au)\s*:?\s*{DAY}", rf"(?i)Date\s*d'expiration\s*:?\s*{DAY}"],
}
PEOPLE = {
    "author": [rf"(?i)(?:Auteur|Author|Rédigé par|Written by)\s*:?\s*{NAME}", rf"(?i)(?:Préparé par|Prepared by)\s*:?\s*{NAME}"],
    "owner": [rf"(?i)(?:Propriétaire|Owner|Responsable)\s*:?\s*{NAME}", rf"(?i)Document Owner\s*:?\s*{NAME}"],
    "approver": [rf"(?i)(?:Approuvé par|Approved by|Validé par)\s*:?\s*{NAME}", rf"(?i)(?:Approbateur|Approver)\s*:?\s*{NAME}"],
}
CLASSES = [r"(?i)(?:Classification|Confidentialité)\s*:?\s*(Public|Interne|Internal|Confidentiel|Confidential|Secret)", rf"{A}(PUBLIC|INTERNE|INTERNAL|CONFIDENTIEL|CONFIDENTIAL|SECRET){Z}", r"(?i)(?:Diffusion|Distribution)\s*:?\s*(Restreinte|Restricted|Limitée|Limited)"]
CLASS_NAMES = {"public": "Public", "interne": "Internal", "internal": "Internal", "confidentiel": "Confidential", "confidential": "Confidential", "secret": "Secret", "restricted": "Restricted"}
DEPARTMENTS = ["IT", "SI", "DSI", "Informatique", "Security", "Sécurité", "SSI", "Legal", "Juridique", "HR", "RH", "Ressources Humaines", "Finance", "Comptabilité", "Operations", "Opérations", "Risk", "Risques", "Compliance", "Conformité", "Audit"]
RELATIONS = {
    "supersedes": [rf"(?i)(?:Remplace|Supersedes|Annule et remplace)\s*:?\s*{REF}", rf"(?i)(?:Ce document remplace|This document supersedes)\s+{REF}"],
    "superseded_by": [rf"(?i)(?:Remplacé par|Superseded by|Obsolète, voir)\s*:?\s*{REF}"],
    "related": [rf"(?i)(?:Voir aussi|See also|Documents? liés?|Related documents?)\s*:?\s*{REF}", rf"(?i)(?:Référence|Reference)\s*:?\s*{REF}"],
}
SENSITIVE = {
    "personal": r"données personnelles|personal data|DCP|nom|prénom|name|surname|adresse|address|email|courriel|e-mail|téléphone|phone|mobile",
    "sensitive": "santé|health|médical|financier|financial|bancaire|banking|judiciaire|judicial|pénal|criminal|biométrique|biometric",
    "identifiers": "NIR|numéro de sécurité sociale|SSN|CNI|carte d'identité|ID card|passeport|passport",
}
SYSTEM = rf"{A}([A-Z]{{2,}}(?:[_-][A-Z0-9]+)*){Z}"
REFERENCES = [
    rf"(?i){A}(?:voir|see|cf\.?|référence|reference)\s+(?:document|section|article|chapitre|chapter)\s+{REF}", rf"(?i){A}(?:conformément à|selon|as per|according to)\s+(?:la|le|l')?(?:article|section|chapitre)?\s*{REF}", rf"\[{REF}\]", rf"{A}((?:POL|PROC|STD|GUI)-[0-9]{{3,}}){Z}",
]
REFERENCE_TYPES = {"policy": ["politique", "policy", "pol-"], "procedure": ["procédure", "procedure", "proc-"], "standard": ["standard", "norme", "std-"], "guideline": ["guide", "guideline", "gui-"]}
PERIODS = {"daily": "quotidien|daily", "weekly": "hebdomadaire|weekly", "monthly": "mensuel|monthly", "quarterly": "trimestriel|quarterly", "yearly": "annuel|annual|yearly"}
DELAY = rf"(?i){A}([0-9]+\s*(?:jours?|days?|semaines?|weeks?|mois|months?|ans?|years?)){Z}"
URGENT = rf"(?i){A}(immédiat|immediate|urgent|dans les plus brefs délais|as soon as possible|asap){Z}"


def unicode_case(pattern: str) -> str:
    """The pattern for Java, whose case folding must be told to go beyond ASCII."""
    return pattern.replace("(?i)", "(?iu)")


def first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, unicode_case(p), 1), F.lit("")) for p in patterns])


def day(found: Column) -> Column:
    """A day of dd/mm/yy(yy); two figures up to 50 are of this century; null where there is no such day."""
    p = F.split(F.replace(found, F.lit("-"), F.lit("/")), "/")
    year = F.get(p, F.lit(2)).cast("int")
    full = F.when(F.length(F.get(p, F.lit(2))) == 2, year + F.when(year > 50, 1900).otherwise(2000)).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%s-%s", full, F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lpad(F.get(p, F.lit(0)), 2, "0")), "yyyy-MM-dd")


def person(text: Column, role: str) -> Column:
    """The first name of four to 49 letters."""
    names = [F.regexp_replace(F.regexp_replace(F.regexp_extract(text, unicode_case(p), 1), r"\s+", " "), r"^[\s.,;:]+|[\s.,;:]+$", "") for p in PEOPLE[role]]
    return F.coalesce(*[F.when(F.length(n).between(4, 49), n) for n in names])


def classification(text: Column) -> Column:
    found = F.lower(first(text, CLASSES))
    return reduce(lambda w, kv: w.when(found == kv[0], kv[1]), list(CLASS_NAMES.items())[1:], F.when(found == "public", "Public"))


def department(text: Column) -> Column:
    return reduce(lambda w, d: w.when(text.rlike(f"(?iu){A}{d}{Z}"), d), DEPARTMENTS[1:], F.when(text.rlike(f"(?iu){A}{DEPARTMENTS[0]}{Z}"), DEPARTMENTS[0]))


def every(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(unicode_case(p)), F.lit(1)) for p in patterns]))


def _tagged(kind: str, name: str, of=lambda c: c):
    return lambda c: F.struct(F.lit(kind).alias("kind"), of(c).alias(name))


def relations(text: Column) -> Column:
    """array<struct<kind, ref>> of the documents named, each once."""
    parts = [F.transform(F.filter(every(text, p), lambda r: (F.length(r) < 30) & r.rlike("^[A-Z0-9.-]+$") & r.rlike("[0-9]")), _tagged(k, "ref")) for k, p in RELATIONS.items()]
    return F.array_distinct(F.flatten(F.array(*parts)))


def sensitivity(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?iu){A}(?:{p}){Z}"), F.lit(k)) for k, p in SENSITIVE.items()]))


def systems(text: Column) -> Column:
    """Acronyms of three letters or more, each once, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(SYSTEM), F.lit(1)), lambda s: F.length(s) > 2)))


def reference_type(ref: Column) -> Column:
    low = F.lower(ref)
    hit = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    kinds = list(REFERENCE_TYPES.items())
    return reduce(lambda w, kv: w.when(hit(kv[1]), kv[0]), kinds[1:], F.when(hit(kinds[0][1]), kinds[0][0])).otherwise("unknown")


def time_terms(text: Column) -> Column:
    """array<struct<kind, term>>: delays, periods and urgent wishes in a text."""
    delay = F.transform(F.regexp_extract_all(text, F.lit(unicode_case(DELAY)), F.lit(1)), _tagged("delay", "term", F.lower))
    urgent = F.transform(F.regexp_extract_all(text, F.lit(unicode_case(URGENT)), F.lit(1)), _tagged("urgent", "term", F.lower))
    period = [F.transform(F.regexp_extract_all(text, F.lit(f"(?iu){A}({p}){Z}"), F.lit(1)), _tagged(k, "term", F.lower)) for k, p in PERIODS.items()]
    return F.flatten(F.array(delay, urgent, *period))
