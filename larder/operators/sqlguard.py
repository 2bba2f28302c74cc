"""What an ad-hoc query may be, read off Spark's own plans.

The parsed plan shows what kind of statement a text is before anything is analysed or run: only nodes of queries may stand in it, relations
have one name, and functions are Spark's own. The analysed plan shows what names turned out to be: rows come from registered views or from
the query itself, and no expression leaves Spark's built-in ones. Literals, comments and column names never matter, as no text is searched.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from larder.errors import QueryError

# Nodes of plans that only read: as parsed, and as analysed.
QUERY_NODES = frozenset(
    """
    Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join
    LateralJoin LocalLimit LocalRelation NamedParametersQuery Offset OneRowRelation PipeOperator Pivot PosParameterizedQuery Project Range
    RebalancePartitions Repartition RepartitionByExpression ResolvedHint ResolvedInlineTable Sample Sort SubqueryAlias Tail Union Unpivot
    UnpivotTransformer UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith View Window WithCTE WithWindowDefinition
    """.split()
)
# Functions of Spark that call into the JVM or load code by name.
REFUSED_FUNCTIONS = frozenset(["reflect", "try_reflect", "java_method"])
TABLE_FUNCTIONS = frozenset(
    "range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split()
)
# Expressions that run code from outside Spark's library of functions, or code named by a string.
REFUSED_EXPRESSIONS = frozenset(
    """
    CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF UnresolvedPythonUDTF ScalaUDAF ScalaAggregator TypedAggregateExpression
    HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction UserDefinedGenerator ApplyFunctionExpression V2Aggregator
    """.split()
)
_CATALYST = "org.apache.spark.sql.catalyst."


class _Tree:
    """Walks a plan of the JVM: all nodes and expressions, wherever a node holds them (children, subqueries, named queries, windows)."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.kind = lru_cache(maxsize=None)(self._kind)
        self.samples: dict[str, object] = {}

    def _kind(self, name: str) -> str:
        thing = self.samples[name]
        for kind, parent in (
            ("skip", "org.apache.spark.sql.types.DataType"),
            ("plan", _CATALYST + "plans.logical.LogicalPlan"),
            ("expression", _CATALYST + "expressions.Expression"),
            ("tree", _CATALYST + "trees.TreeNode"),
            ("many", "scala.collection.Iterable"),
            ("product", "scala.Product"),
        ):
            if is_instance_of(self.gateway, thing, parent):
                return kind
        return "skip"

    def nodes(self, plan) -> Iterator[tuple[str, str, str, object]]:
        """``(kind, package, class, node)``; views, attributes and literals are not entered."""
        left = [plan]
        while left:
            thing = left.pop()
            if not hasattr(thing, "getClass"):
                continue
            name = thing.getClass().getName()
            self.samples.setdefault(name, thing)
            kind = self.kind(name)
            package, _, plain = name.rpartition(".")
            if kind in ("plan", "expression", "tree"):
                yield kind, package, plain, thing
                if plain in ("View", "UnresolvedRelation", "AttributeReference", "UnresolvedAttribute", "Literal"):
                    continue
            if kind in ("plan", "expression", "tree", "product"):
                left += _each(thing.productIterator())
            elif kind == "many":
                left += _each(thing.iterator())


def _each(iterator) -> Iterator:
    while iterator.hasNext():
        yield iterator.next()


def check_parsed(spark: SparkSession, sql: str) -> str:
    """The text when it is one query of views and Spark's own functions, else QueryError. Nothing is analysed."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise QueryError("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise QueryError(f"only SELECT queries are allowed: {error.getCondition()}") from error
    jvm = spark.sparkContext._jvm
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()

    def called(name: str, allowed) -> None:
        if not allowed(name.lower()):
            raise QueryError(f"forbidden function: {name}")

    def own(name: str) -> bool:
        return name not in REFUSED_FUNCTIONS and builtin.functionExists(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))

    for kind, _, plain, node in _Tree(spark).nodes(plan):
        if "UnresolvedIdentifier" in plain:
            raise QueryError("forbidden clause: identifier")
        if kind == "plan" and plain not in QUERY_NODES:
            raise QueryError(f"forbidden statement: {plain}")
        if plain == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            raise QueryError(f"not a view: {node.multipartIdentifier().mkString('.')}")
        if plain == "UnresolvedFunction":
            called(node.nameParts().mkString("."), own)
        elif plain == "UnresolvedGenerator":
            called(node.name().unquotedString(), own)
        elif plain == "UnresolvedTableValuedFunction":
            called(node.name().mkString("."), TABLE_FUNCTIONS.__contains__)
    return text


def check_analysed(df: DataFrame, views: Collection[str] | None = None) -> DataFrame:
    """``df`` when its rows come from temporary views (of the given names, or any) and all expressions are Spark's own, else QueryError."""
    allowed = None if views is None else {v.lower() for v in views}
    for kind, package, plain, node in _Tree(df.sparkSession).nodes(df._jdf.queryExecution().analyzed()):
        if kind == "plan" and plain not in QUERY_NODES:
            raise QueryError(f"not a view: {plain}")
        if plain == "View":
            name = node.desc().identifier().table()
            if not node.isTempView() or (allowed is not None and name.lower() not in allowed):
                raise QueryError(f"not a registered view: {name}")
        if kind == "expression" and (plain in REFUSED_EXPRESSIONS or not package.startswith(_CATALYST)):
            raise QueryError(f"forbidden expression: {plain}")
    return df


def guarded(spark: SparkSession, sql: str, params=None, views: Collection[str] | None = None) -> DataFrame:
    """The query, checked as parsed and as analysed; it has not run when it is refused."""
    text = check_parsed(spark, sql)
    try:
        df = spark.sql(text, args=params) if params else spark.sql(text)
    except AnalysisException as error:
        raise QueryError(str(error)) from error
    return check_analysed(df, views)
