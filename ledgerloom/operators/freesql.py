"""Read-only SQL over the loaded tables."""

from __future__ import annotations

import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import Tables

_CATALYST = "org.apache.spark.sql.catalyst"
# Plan nodes that change something, run other programs, or hide a statement in a string.
_FORBIDDEN_NODES = (
    f"{_CATALYST}.plans.logical.Command",
    f"{_CATALYST}.plans.logical.ParsedStatement",
    f"{_CATALYST}.plans.logical.ScriptTransformation",
    f"{_CATALYST}.analysis.UnresolvedExecuteImmediate",
    # IDENTIFIER(...): what it stands for is only built during analysis.
    f"{_CATALYST}.analysis.PlanWithUnresolvedIdentifier",
)
# Statements that only describe.
_ALLOWED_ROOTS = (
    f"{_CATALYST}.plans.logical.ShowTables",
    f"{_CATALYST}.plans.logical.DescribeRelation",
    "org.apache.spark.sql.execution.command.ExplainCommand",
)
_SUBQUERY = f"{_CATALYST}.expressions.PlanExpression"
_IDENTIFIER = f"{_CATALYST}.analysis.ExpressionWithUnresolvedIdentifier"
_RELATION = f"{_CATALYST}.analysis.UnresolvedRelation"
_FUNCTION = f"{_CATALYST}.analysis.UnresolvedFunction"
_FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


class ReadOnlyViolation(ValueError):
    """The statement is more than a query."""


def _items(spark: SparkSession, scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def check_read_only(spark: SparkSession, sql: str) -> set[str] | None:
    """The names the statement reads (None: those of all tables); raises unless every node of its plan only reads.

    The parsed plan decides, not the text: a column called ``last_updated`` is
    fine, and an INSERT below a WITH is found.
    """
    gateway = spark.sparkContext._gateway
    root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if any(is_instance_of(gateway, root, name) for name in _ALLOWED_ROOTS):
        return None
    plans, expressions, names = [root], [], set()
    while plans or expressions:
        if plans:
            node = plans.pop()
            for name in _FORBIDDEN_NODES:
                if is_instance_of(gateway, node, name):
                    raise ReadOnlyViolation(f"not a read-only statement: {node.nodeName()}")
            if is_instance_of(gateway, node, _RELATION):
                names.add(_items(spark, node.multipartIdentifier())[-1].lower())
            plans += _items(spark, node.children())
            # innerChildren holds plans (WITH definitions) and, on some nodes, expressions.
            for inner in _items(spark, node.innerChildren().toSeq()):
                is_plan = is_instance_of(gateway, inner, f"{_CATALYST}.plans.logical.LogicalPlan")
                (plans if is_plan else expressions).append(inner)
            expressions += _items(spark, node.expressions())
        else:
            expression = expressions.pop()
            if is_instance_of(gateway, expression, _SUBQUERY):
                plans.append(expression.plan())
            if is_instance_of(gateway, expression, _IDENTIFIER):
                raise ReadOnlyViolation("not a read-only statement: IDENTIFIER")
            if is_instance_of(gateway, expression, _FUNCTION):
                parts = _items(spark, expression.nameParts())
                if parts[-1].lower() in _FORBIDDEN_FUNCTIONS:
                    raise ReadOnlyViolation(f"function not allowed: {parts[-1]}")
            expressions += _items(spark, expression.children())
    return names


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, but views of its own, in which files cannot be read by path."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    return own


def _query(t: Tables, sql: str) -> DataFrame:
    """The statement in a session of its own, which sees the tables it names; the caller's views and settings stay."""
    names = check_read_only(t.spark, sql)
    own = _own_session(t.spark)
    for name in t.names if names is None else [n for n in t.names if n in names]:
        # Global views are how a frame gets from one session to another.
        passed = f"{name}_{uuid.uuid4().hex}"
        t[name].createGlobalTempView(passed)
        try:
            own.table(f"global_temp.{passed}").createTempView(name)
        finally:
            t.spark.catalog.dropGlobalTempView(passed)
    return own.sql(sql)


def run_sql_query(t: Tables, sql: str, limit: int | None = 100) -> DataFrame:
    """The first rows of a query over the loaded tables, which it sees as views; ``run_sql_query_summary`` has their total."""
    rows = _query(t, sql)
    return rows if limit is None else rows.limit(limit)


def run_sql_query_summary(t: Tables, sql: str) -> DataFrame:
    """How many rows the query has in all."""
    return _query(t, sql).agg(F.count(F.lit(1)).alias("rows"))
