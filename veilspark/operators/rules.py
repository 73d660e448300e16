"""Statements (UPDATE and DELETE) over the tables of a database that is kept in part, as projections.

The statements are read by Spark's own parser. All statements of a table make one projection: a flag for each
statement says which rows it meets, in order, and each sees what the ones before it left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.columns import named

COUNTS = "position int, table_name string, operation string, rows_affected long"


@dataclass(frozen=True)
class Ruled:
    """tables: by name, after the statements. counts: position, table_name, operation, rows_affected of those that ran.
    errors: operation, table_name, column_name of those that could not, which stop no other."""

    tables: dict[str, DataFrame]
    counts: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Statement:
    operation: str
    table: str
    assigned: tuple[tuple[str, str], ...]
    condition: str | None


def rules_of(path: str) -> tuple[str, ...] | None:
    """The statements for a database at this path; null for one without a rule."""
    return next((statements for end, statements in C.DATABASE_RULES if path.lower().endswith(end.lower())), None)


def portable(sql: str) -> str:
    """The statement in Spark's dialect: LIKE ignores case, names in double quotes, no escapes in strings."""

    def turn(m: re.Match) -> str:
        text = m.group()
        if text.startswith("'"):
            return "'" + text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"
        if text.startswith('"'):
            return named(text[1:-1].replace('""', '"'))
        return "ILIKE"

    return re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\bLIKE\b", turn, sql, flags=re.I)


def parse(spark: SparkSession, sql: str) -> Statement:
    """Raises ParseException for what is no statement, ValueError for another kind of one."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(portable(sql))
    kind = plan.nodeName()
    if kind not in ("UpdateTable", "DeleteFromTable"):
        raise ValueError(f"neither UPDATE nor DELETE: {kind}")
    relation = plan.table()
    while relation.nodeName() == "SubqueryAlias":
        relation = relation.child()
    names = relation.multipartIdentifier()
    table = names.apply(names.size() - 1)
    if kind == "DeleteFromTable":
        condition = plan.condition().sql()
        return Statement("delete", table, (), None if condition == "true" else condition)
    pairs = plan.assignments()
    assigned = tuple((".".join(_parts(pairs.apply(i).key().nameParts())), pairs.apply(i).value().sql()) for i in range(pairs.size()))
    return Statement("update", table, assigned, plan.condition().get().sql() if plan.condition().isDefined() else None)


def _parts(names) -> list[str]:  # noqa: ANN001
    return [names.apply(i) for i in range(names.size())]


def apply_rules(tables: dict[str, DataFrame], statements: tuple[str, ...] | list[str], spark: SparkSession) -> Ruled:
    """The tables after all statements. Null conditions meet no row; names ignore case; a value of another type than
    its column makes the column text. Counts are one pass for each table that has statements."""
    at = {name.lower(): name for name in tables}
    if any(c.startswith(("_alive_", "_hit_")) for df in tables.values() for c in df.columns):
        raise ValueError("columns named _alive_ or _hit_ are used here")
    state: dict[str, DataFrame] = {}
    done: dict[str, list[tuple[int, str]]] = {}
    errors = []
    for position, sql in enumerate(statements):
        operation, name = "parse", None
        try:
            statement = parse(spark, sql)
            operation, name = statement.operation, at.get(statement.table.lower(), statement.table)
            if name not in tables:
                raise ValueError("no such table")
            df = state.get(name)
            df = tables[name].withColumn("_alive_", F.lit(True)) if df is None else df
            met = F.col("_alive_") & (F.lit(True) if statement.condition is None else F.coalesce(F.expr(statement.condition), F.lit(False)))
            flagged = df.withColumn(f"_hit_{position}_", met)
            hit = F.col(f"_hit_{position}_")
            if statement.operation == "delete":
                after = flagged.withColumn("_alive_", F.col("_alive_") & ~hit)
            else:
                after = flagged.withColumns(_assigned(flagged, statement, hit))
            state[name] = after
            done.setdefault(name, []).append((position, operation))
        except (PySparkException, ValueError):
            errors.append((operation, name, None))
    counts = spark.createDataFrame([], COUNTS)
    for name, ran in done.items():
        sums = state[name].agg(*[F.count_if(f"_hit_{p}_").alias(f"n{p}") for p, _ in ran])
        counts = counts.unionByName(sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(name).alias("table_name"), F.lit(o).alias("operation"), F.col(f"n{p}").alias("rows_affected")) for p, o in ran]))))
    out = {name: state[name].where("_alive_").select(*[named(c) for c in df.columns]) if name in state else df for name, df in tables.items()}
    return Ruled(out, counts, spark.createDataFrame(errors, "operation string, table_name string, column_name string"))


def _assigned(df: DataFrame, statement: Statement, hit: Column) -> dict[str, Column]:
    """All values are taken from the row as it was before the statement."""
    real = {c.lower(): c for c in df.columns}
    new = {}
    for column, value in statement.assigned:
        c = real.get(column.lower())
        if c is None:
            raise ValueError("no such column")
        old, put = F.col(named(c)), F.expr(value)
        given, kept = df.select(put.alias("v")).schema[0].dataType.simpleString(), df.schema[c].dataType.simpleString()
        if given not in ("void", kept):
            old, put = old.cast("string"), put.cast("string")
        new[c] = F.when(hit, put).otherwise(old)
    return new
