"""Ad-hoc questions over registered views: queries only."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Spark's names of the parsed plans that only read. Whatever else stands anywhere in a text makes it no query.
READS = frozenset("""
    Aggregate CTERelationDef Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range
    Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedWith Window WithWindowDefinition
""".split())
#: Functions that run code by its name.
RUNS = frozenset(("reflect", "java_method", "try_reflect"))
#: Functions that may stand in place of a table.
TABLES = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _plans(top: JavaObject) -> Iterator[JavaObject]:
    """A parsed plan and all below it, common table expressions included."""
    yield top
    for below in (top.children(), top.innerChildren()):
        for x in _each(below):
            if _is_plan(x):
                yield from _plans(x)


def _is_plan(x: JavaObject) -> bool:
    return ".plans." in (name := x.getClass().getName()) or ".catalyst.analysis." in name and hasattr_(x, "innerChildren") and hasattr_(x, "outputSet")


def hasattr_(x: JavaObject, method: str) -> bool:
    return any(m.getName() == method for m in x.getClass().getMethods())


def _expressions(e: JavaObject) -> Iterator[JavaObject]:
    yield e
    for x in _each(e.children()):
        yield from _expressions(x)


def _reads(plan: JavaObject) -> bool:
    for p in _plans(plan):
        kind = p.getClass().getSimpleName()
        if kind not in READS:
            return False
        if kind == "UnresolvedTableValuedFunction" and _name(p.name()) not in TABLES:
            return False
        for e in _each(p.expressions()):
            for x in _expressions(e):
                if x.getClass().getSimpleName() == "UnresolvedFunction" and _name(x.nameParts()) in RUNS:
                    return False
                # a subquery in an expression holds a plan of its own
                if hasattr_(x, "plan") and not _reads(x.plan()):
                    return False
    return True


def _tables(plan: JavaObject) -> Iterator[tuple[str, ...]]:
    """The names of all tables that a plan reads, those of subqueries included; not those that it defines itself."""
    for p in _plans(plan):
        if p.getClass().getSimpleName() == "UnresolvedRelation":
            yield tuple(_each(p.multipartIdentifier()))
        for e in _each(p.expressions()):
            for x in _expressions(e):
                if hasattr_(x, "plan"):
                    yield from _tables(x.plan())


def _defined(plan: JavaObject) -> Iterator[str]:
    """Names of common table expressions."""
    for p in _plans(plan):
        if p.getClass().getSimpleName() == "UnresolvedWith":
            for pair in _each(p.cteRelations()):
                yield pair.productElement(0).lower()
        for e in _each(p.expressions()):
            for x in _expressions(e):
                if hasattr_(x, "plan"):
                    yield from _defined(x.plan())


def _name(parts: JavaObject) -> str:
    return parts.last().lower()


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's own parser takes the text for a query, with nothing in it but what reads."""
    return _reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def run_query(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """The query's rows. It reads the given views and what it defines itself, no other table and no file. The views are there for it alone: others of their names come
    back afterwards."""
    if not is_read_only(spark, sql):
        raise PermissionError("only queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    known = {v.lower() for v in views} | {*_defined(plan)}
    if other := [".".join(t) for t in _tables(plan) if len(t) > 1 or t[0].lower() not in known]:
        raise PermissionError(f"not among the views: {', '.join(sorted({*other}))}")
    before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in views}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args=args or {})
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
