"""What a SQL statement reads, does and calls, as Spark's parser and analyser find it.

A statement is judged twice. The parsed plan may hold only known steps, expressions and functions, and names tables of
allowed schemas or common tables. The analysed plan, in which every name is resolved in its own scope, may read only what
was allowed: a common table that hides or reveals another name is seen for what it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.guard import NO_RELATION, OUT_OF_SCOPE

STEP = "Step is not allowed: "
FUNCTION = "Function is not allowed: "

# Steps of a parsed query. Scripts, generators, table functions, files by path and past versions are not among them.
STEPS = frozenset((
    "Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition",
))
# What may still be unresolved in an expression; a function or table named by a computed text is not among them.
UNRESOLVED = frozenset((
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction",
    "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedRegex", "UnresolvedStar",
    "UnresolvedStarExceptOrReplace",
))
# Functions that compute from their arguments alone. Those that call code by name, read files, wait or give away the
# session are not among them.
FUNCTIONS = frozenset("""
    abs ceil ceiling exp floor greatest least ln log log10 log2 mod negative pmod positive pow power round sign
    signum sqrt cbrt try_add try_divide try_multiply try_subtract width_bucket
    any any_value approx_count_distinct approx_percentile array_agg avg bool_and bool_or collect_list collect_set corr
    count count_if every first first_value grouping grouping_id last last_value listagg max
    max_by mean median min min_by mode percentile percentile_approx percentile_cont percentile_disc some std stddev
    stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    coalesce if iff ifnull isnan isnotnull isnull nanvl nullif nvl nvl2 between not
    ascii char char_length character_length concat concat_ws contains endswith format_number initcap instr left
    length like lower lpad ltrim position regexp_count regexp_extract regexp_like regexp_replace repeat replace
    reverse right rlike rpad rtrim split split_part startswith substr substring trim upper
    add_months date date_add date_diff date_format date_part date_sub date_trunc dateadd datediff datepart day dayofmonth
    dayofweek dayofyear extract hour last_day make_date minute month months_between next_day quarter second to_date
    to_timestamp trunc try_to_date try_to_timestamp weekday weekofyear year now current_date current_timestamp
    array array_contains array_distinct array_join array_max array_min array_sort cardinality element_at exists filter
    forall named_struct size slice sort_array struct transform
    bigint boolean cast decimal double float int smallint string timestamp tinyint to_number try_cast try_to_number
""".split())
# Classes of resolved expressions that run code from outside the engine.
FOREIGN_CODE = frozenset((
    "CallMethodViaReflection", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaAggregator", "ScalaUDAF",
    "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction",
))
UNREAD = ("CTERelationRef", "LocalRelation", "OneRowRelation")


@dataclass(frozen=True)
class Place:
    """A table of an allowed schema and where the statement names it; ``bare`` if neither an alias nor a sample follows."""

    schema: str
    table: str
    start: int
    bare: bool


def _each(items) -> Iterator:
    return (items.apply(k) for k in range(items.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _below(node) -> Iterator:
    """The plans under a plan, those of common tables and of subqueries in expressions included."""
    for child in (*_each(node.children()), *_each(node.innerChildren()), *_each(node.subqueries())):
        if hasattr(child, "innerChildren"):
            yield child


def _nodes(plan, parent: str = "") -> Iterator[tuple]:
    """Every node of a plan with the kind of its parent."""
    yield plan, parent
    for node in _below(plan):
        yield from _nodes(node, _kind(plan))


def _expressions(node) -> Iterator:
    """Every expression of one plan node."""
    pending = list(_each(node.expressions()))
    while pending:
        one = pending.pop()
        yield one
        pending += _each(one.children())


def _check_call(expression) -> None:
    """A ValueError for an expression that the parsed statement may not hold."""
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        name = ".".join(_each(expression.nameParts())).lower()
        if name not in FUNCTIONS:
            raise ValueError(FUNCTION + name)
    elif ".catalyst.analysis." in expression.getClass().getName() and kind not in UNRESOLVED:
        raise ValueError(FUNCTION + kind)


def check_parsed(spark: SparkSession, query: str, allowed_schemas: tuple[str, ...]) -> list[Place]:
    """Every table of the statement in an allowed schema; a ValueError for what it may not read, do or call."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    nodes = list(_nodes(plan))
    own = {
        pair._1().lower()
        for node, _ in nodes if _kind(node) == "UnresolvedWith" for pair in _each(node.cteRelations())
    }
    allowed, found = {name.lower() for name in allowed_schemas}, set()
    for node, parent in nodes:
        kind = _kind(node)
        if kind == "UnresolvedRelation":
            parts = [part.lower() for part in _each(node.multipartIdentifier())]
            if len(parts) == 1 and parts[0] in own:
                continue
            if len(parts) != 2 or parts[0] not in allowed or not node.options().isEmpty():
                raise ValueError(OUT_OF_SCOPE + ".".join(parts))
            bare = parent not in ("SubqueryAlias", "Sample", "UnresolvedSubqueryColumnAliases")
            found.add(Place(parts[0], parts[1], node.origin().startIndex().get(), bare))
        elif kind not in STEPS:
            raise ValueError((OUT_OF_SCOPE if node.children().isEmpty() else STEP) + kind)
        for expression in _expressions(node):
            _check_call(expression)
    if not found:
        raise ValueError(NO_RELATION)
    return sorted(found, key=lambda place: place.start)


def _schema(name) -> str:
    """The schema of a table's name in the catalog, empty if it has none."""
    return name.database().get() if name.database().isDefined() else ""


def _reads(node) -> str:
    """What a leaf or view of an analysed plan reads: a schema, a temporary view as ``.name``, or else its kind."""
    kind = _kind(node)
    if kind == "View":
        name = node.desc().identifier()
        return f".{name.table()}" if node.isTempView() else _schema(name)
    if kind == "LogicalRelation" and node.catalogTable().isDefined():
        return _schema(node.catalogTable().get().identifier())
    if kind == "HiveTableRelation":
        return _schema(node.tableMeta().identifier())
    return kind


def check_analysed(df: DataFrame, allowed_schemas: tuple[str, ...], views: set[str]) -> None:
    """A ValueError if the resolved statement reads anything but tables of the schemas and the named temporary views."""
    allowed = {name.lower() for name in allowed_schemas} | {f".{name.lower()}" for name in views}
    pending = [df._jdf.queryExecution().analyzed()]
    while pending:
        node = pending.pop()
        kind = _kind(node)
        if kind == "View" or (node.children().isEmpty() and kind not in UNREAD):
            reads = _reads(node)
            if reads.lower() not in allowed:
                raise ValueError(OUT_OF_SCOPE + (reads.lstrip(".") or kind))
            continue
        for expression in _expressions(node):
            if _kind(expression) in FOREIGN_CODE:
                raise ValueError(FUNCTION + _kind(expression))
        pending += _below(node)
