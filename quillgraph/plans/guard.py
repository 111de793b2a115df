"""Ad-hoc read-only SQL over the graph views: checked, capped, timed out, and rendered as JSON."""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 2**53 - 1
#: Nodes of a parsed query that only read; every other one is rejected, commands of any kind among them.
READING = frozenset(
    "Aggregate CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation ParameterizedQuery Pivot Project Range Sample Sort SubqueryAlias "
    "Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Window WithWindowDefinition".split()
)
#: Functions that may stand where a table does.
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer range stack".split())
#: Functions that reach out of the query: into the JVM, or to the files behind it.
OUTSIDE = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())


class QueryRejected(ValueError):
    pass


class ResultTooLarge(RuntimeError):
    pass


class QueryTimeout(RuntimeError):
    pass


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def check_read_only(spark: SparkSession, sql: str, most_chars: int = 10_000) -> None:
    """Raises unless the text is one query over the session's temporary views and its own common table expressions.

    The text is parsed, but not resolved, so nothing of it runs; then every node of the plan, of its subqueries and of its
    expressions must be among those that only read, every relation a view's plain name, and no function one that reaches
    outside. Quoted names and comments are read by the parser, so they hide nothing."""
    if not sql.strip() or len(sql) > most_chars:
        raise QueryRejected("a query has 1 to %d characters" % most_chars)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as e:
        raise QueryRejected(str(e).splitlines()[0]) from e
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    waiting = [(plan, frozenset())]
    while waiting:
        node, known = waiting.pop()
        kind = _kind(node)
        if kind not in READING:
            raise QueryRejected(f"{kind} does more than read")
        if kind == "UnresolvedWith":
            known |= {c._1().lower() for c in _items(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            name = _items(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in views | known:
                raise QueryRejected(f"no view {'.'.join(name)}")
        elif kind == "UnresolvedTableValuedFunction" and (len(_items(node.name())) != 1 or node.name().last().lower() not in TABLE_FUNCTIONS):
            raise QueryRejected(f"no table function {node.name().last()}")
        waiting += [(x, known) for x in _items(node.children())]
        waiting += [(x, known) for x in _items(node.innerChildren()) if kind == "UnresolvedWith"]
        inside = _items(node.expressions())
        while inside:
            e = inside.pop()
            if _kind(e) in ("UnresolvedFunction", "UnresolvedGenerator"):
                name = [x.lower() for x in _items(e.nameParts())] if _kind(e) == "UnresolvedFunction" else [e.name().funcName().lower()]
                if len(name) > 1 or name[-1] in OUTSIDE:
                    raise QueryRejected(f"no calls of {'.'.join(name)}")
            if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e):
                waiting.append((e.plan(), known))
            inside += _items(e.children())


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; whole numbers beyond 2**53 as strings, times in ISO form, nulls kept."""
    cols = [F.when(F.abs(F.col(f.name)) > SAFE, F.to_json(F.struct(F.col(f.name).cast("string").alias("v")))).otherwise(F.to_json(F.struct(F.col(f.name).alias("v")), {"ignoreNullFields": "false"})) if isinstance(f.dataType, T.LongType) else F.to_json(F.struct(F.col(f.name).alias("v")), {"ignoreNullFields": "false"}) for f in df.schema.fields]
    pair = [F.concat(F.lit(f'"{f.name}":'), F.substring(c, F.lit(6), F.length(c) - 6)) for f, c in zip(df.schema.fields, cols)]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *pair), F.lit("}")).alias("row"))


def run_query(spark: SparkSession, sql: str, max_rows: int = 10_000, timeout_s: float = 30.0, args: dict | None = None) -> dict:
    """{rows, row_count, query_hash}: rows as JSON texts. More than max_rows raise, as a part of a result misleads; a query
    that takes longer than timeout_s is cancelled."""
    check_read_only(spark, sql)
    group = f"quillgraph-{uuid.uuid4().hex}"
    try:
        df = spark.sql(sql, args=args) if args else spark.sql(sql)
    except PySparkException as e:
        raise QueryRejected(str(e).splitlines()[0]) from e
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(group)

    timer = threading.Timer(timeout_s, stop)
    spark.addTag(group)
    timer.start()
    try:
        rows = [r["row"] for r in json_rows(df).limit(max_rows + 1).collect()]
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"took more than {timeout_s} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(group)
    if len(rows) > max_rows:
        raise ResultTooLarge(f"more than {max_rows} rows: add a LIMIT")
    return {"rows": rows, "row_count": len(rows), "query_hash": hashlib.sha256(sql.encode()).hexdigest()[:12]}
