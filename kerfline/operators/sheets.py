"""Roll-ups of the tables found in documents: control matrices, risk registers, inventories, other tables.

A table is an array of rows of cells; its first row with content is the header.

Defined results: a table without content is left out; a missing column, or a null cell, gives the default class;
blank rows don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.operators.security import status, table_kind

# Words in the header of a column, and words of the levels.
COLUMNS = {
    "control_matrix": {"name": ["contrôle", "control", "mesure", "id"], "label": ["statut", "status", "état", "conformité"], "group": ["référence", "reference", "norme", "standard"]},
    "risk_register": {"name": ["risque", "risk", "menace", "threat"], "label": ["niveau", "level", "criticité"], "group": ["impact"]},
    "inventory": {"name": ["nom", "name", "actif", "asset", "id"], "label": ["criticité", "criticality", "importance"], "group": ["type", "catégorie", "category"]},
}
RISKS = {"critique": ["critique", "critical", "très élevé", "very high"], "élevé": ["élevé", "high", "important"], "moyen": ["moyen", "medium", "modéré"], "faible": ["faible", "low", "mineur"]}
ASSETS = {"critique": ["critique", "critical", "vital"], "élevée": ["élevé", "high", "important"], "moyenne": ["moyen", "medium", "normal"]}


def level(cell: Column, table: dict[str, list[str]], default: str) -> Column:
    low = F.lower(F.coalesce(cell, F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    kinds = list(table.items())
    return reduce(lambda w, kv: w.when(hit(kv[1]), kv[0]), kinds[1:], F.when(hit(kinds[0][1]), kinds[0][0])).otherwise(default)


def column_index(header: Column, words: list[str]) -> Column:
    """0-based place of the first header that contains one of ``words``; null where none does."""
    hit = F.transform(header, lambda h: reduce(lambda a, b: a | b, [F.lower(F.coalesce(h, F.lit(""))).contains(w) for w in words]))
    at = F.array_position(hit, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def filled(row: Column) -> Column:
    return F.exists(row, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def records(df: DataFrame, key: str, tables: str) -> DataFrame:
    """(key, table_no, kind, title, row_no, name, class, grouping, cells) of every row under a header."""
    x = df.select(key, F.posexplode(tables).alias("table_no", "_t"))
    x = x.select(key, "table_no", F.col("_t.title").alias("title"), table_kind(F.col("_t.data")).alias("kind"), F.filter(F.col("_t.data"), filled).alias("_rows")).where(F.size("_rows") > 0)
    head = F.get("_rows", F.lit(0))
    for part in ("name", "label", "group"):
        at = F.when(F.lit(False), F.lit(0))
        for kind, columns in COLUMNS.items():
            at = at.when(F.col("kind") == kind, column_index(head, columns[part]))
        x = x.withColumn(f"_{part}", at)
    x = x.select(key, "table_no", "title", "kind", "_name", "_label", "_group", F.posexplode_outer(F.slice("_rows", 2, F.size("_rows"))).alias("row_no", "_cells")).where("row_no IS NOT NULL")
    cell = lambda part: F.get("_cells", F.col(f"_{part}"))
    label = F.coalesce(cell("label"), F.lit(""))
    of = F.when(F.col("kind") == "control_matrix", status(label)).when(F.col("kind") == "risk_register", level(label, RISKS, "moyen")).when(F.col("kind") == "inventory", level(label, ASSETS, "faible")).otherwise("row")
    return x.select(key, "table_no", "kind", "title", "row_no", cell("name").alias("name"), of.alias("class"), F.coalesce(cell("group"), F.lit("")).alias("grouping"), F.col("_cells").alias("cells"))


def rollup(rows: DataFrame, key: str) -> DataFrame:
    """(key, table_no, kind, class, grouping, n): rows of each class and grouping."""
    return rows.groupBy(key, "table_no", "kind", "class", "grouping").agg(F.count(F.lit(1)).alias("n"))


def as_text(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, table_no, row_no, text): the first ``most`` rows of each table as lines, which is what a sample of a table is."""
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    return rows.where(F.col("row_no") < most).select(key, "table_no", "row_no", line.alias("text"))
