"""Read-only SQL over a bundle's datasets: one SELECT, visible tables only, a row limit and a timeout.

The statement is put into Spark's dialect (`dialect`), parsed, and the nodes of its plan are held against lists of
what is allowed; it runs in a session of its own that holds only the visible tables.
"""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.dialect import DialectError, integer_divisions, nodes, rewrite
from marginalia.operators.scope import EVERYTHING, Scope

SCHEMA_TABLE = "_schema"
#: Groups of built-in functions that only compute on their arguments (fixed values).
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs "
    "string_funcs struct_funcs variant_funcs window_funcs table_funcs".split()
)
#: Functions allowed besides, and functions of those groups that aren't.
ALSO = frozenset("typeof range".split())
NOT_THESE = frozenset("sql_keywords collations read_files current_user session_user user raise_error assert_true".split())
#: Nodes of a parsed plan that write, run commands or scripts, or read files (fixed values).
BAD_NODES = re.compile(
    r"(?i)(ScriptTransformation|ScriptInputOutputSchema|Insert\w*|Create\w*|Replace\w*|Drop\w*|Alter\w*|Set\w*Command\w*|SetCatalog\w*|SetNamespace\w*|Unresolved(?:Insert\w*|Table|Namespace|CurrentNamespace|Identifier|TableOrView)\Z|\w*Command\Z|Explain\w*|Cache\w*|Uncache\w*|"
    r"Describe\w*|Show\w*|MergeInto\w*|DeleteFrom\w*|UpdateTable\w*|Add\w*|Truncate\w*|Refresh\w*|Repair\w*|Load\w*|CompoundBody|Call\w*|Optimize\w*|Analyze\w*|Comment\w*|Rename\w*|Declare\w*|Execute\w*)"
)


class SqlError(ValueError):
    """A statement that isn't allowed or doesn't run."""


class SqlTimeout(TimeoutError):
    """A statement that took too long."""


def inspect(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """Relations (not those that WITH names) and functions of a statement, from the nodes of its parsed plan; raises
    SqlError for anything but one query."""
    if not sql.strip():
        raise SqlError("the statement is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlError(str(e).split("\n")[0]) from None
    relations, functions, names = set(), set(), set()
    for full, node in nodes(plan):
        kind = full.rpartition(".")[2]
        if ".expressions." not in full and BAD_NODES.match(kind):
            raise SqlError("only a query is allowed")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() > 1:
                raise SqlError(f"no such table: {parts.mkString('.')}")
            relations.add(parts.apply(0).lower())
        elif kind == "UnresolvedWith":
            pairs = node.cteRelations()
            names |= {pairs.apply(k)._1().lower() for k in range(pairs.size())}
        elif kind == "UnresolvedFunction":
            functions.add(node.nameParts().mkString(".").lower())
        elif kind == "UnresolvedTableValuedFunction":
            functions.add(node.name().mkString(".").lower())
    return relations - names, functions


def allowed_function(spark: SparkSession, name: str) -> bool:
    """Whether a built-in function only computes: its group is one of GROUPS, or it is named in ALSO."""
    if name in ALSO:
        return True
    jvm = spark.sparkContext._jvm
    catalyst = jvm.org.apache.spark.sql.catalyst
    info = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    if not info.isDefined():
        info = catalyst.analysis.TableFunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    return info.isDefined() and info.get().getGroup() in GROUPS and name not in NOT_THESE


def _source(path: str) -> tuple[str, str | None]:
    file, mark, sheet = path.partition("#")
    return file, sheet if mark else None


class Gate:
    """Datasets behind the rules; `sources` names the file that each table comes from."""

    def __init__(self, datasets: Mapping[str, DataFrame], sources: dict[str, str] | None = None, labels: dict[str, dict[str, str]] | None = None):
        self.datasets, self.sources, self.labels = datasets, sources or {}, labels or {}
        self.spark = SparkSession.active()

    def visible(self, scope: Scope = EVERYTHING) -> list[str]:
        """Tables whose source path (without extension) the path rules allow."""
        if not (scope.allow or scope.deny):
            return sorted(self.datasets)
        paths = {n: re.sub(r"\.[^./]+$", "", self.sources.get(n, n)) for n in self.datasets}
        rows = self.spark.createDataFrame(list(paths.items()), "name string, path string")
        return sorted(r["name"] for r in rows.filter(scope.path(rows["path"])).collect())

    def schema_rows(self, scope: Scope = EVERYTHING) -> DataFrame:
        """table_name, position, column_name, label, type, source, sheet of the visible tables; the sheet is null but for
        tables of a workbook, whose source names it behind #."""
        rows = [(n, i, f.name, self.labels.get(n, {}).get(f.name, f.name), f.dataType.simpleString(), *_source(self.sources.get(n, n))) for n in self.visible(scope) for i, f in enumerate(self.datasets[n].schema.fields)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, label string, type string, source string, sheet string")

    def tables(self, scope: Scope = EVERYTHING) -> list[dict]:
        """name, source, rows and columns of each visible table; all are counted in one job."""
        seen = self.visible(scope)
        parts = [self.datasets[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in seen]
        rows = {r["name"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
        return [{"name": n, "source": self.sources.get(n, n), "rows": rows[n], "columns": [(f.name, self.labels.get(n, {}).get(f.name, f.name), f.dataType.simpleString()) for f in self.datasets[n].schema.fields]} for n in seen]

    def plan(self, sql: str, scope: Scope = EVERYTHING) -> DataFrame:
        """The checked query as a DataFrame of the gate's own session."""
        tables = self.visible(scope)
        try:
            text = rewrite(re.sub(r";\s*$", "", sql.strip()))
        except DialectError as e:
            raise SqlError(str(e)) from None
        relations, functions = inspect(self.spark, text)
        allowed = {n.lower() for n in tables} | ({SCHEMA_TABLE} if len(tables) == len(self.datasets) else set())
        if bad := relations - allowed:
            raise SqlError(f"no such table: {', '.join(sorted(bad))}")
        if bad := {f for f in functions if not allowed_function(self.spark, f)}:
            raise SqlError(f"not allowed: {', '.join(sorted(bad))}")
        session = self.spark.newSession()
        session.conf.set("spark.sql.ansi.enabled", "false")
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        for n in tables:
            if n.lower() in relations:
                self._share(session, n, self.datasets[n])
        if SCHEMA_TABLE in relations:
            self._share(session, SCHEMA_TABLE, self.schema_rows(scope))
        try:
            df = session.sql(text)
            while at := integer_divisions(df._jdf.queryExecution().analyzed(), text):  # those around them may follow
                for k in reversed(at):
                    text = f"{text[:k]} div {text[k + 1 :]}"
                df = session.sql(text)
            return df
        except Exception as e:
            raise SqlError(str(e).split("\n")[0]) from None

    def _share(self, session: SparkSession, name: str, df: DataFrame) -> None:
        """A temporary view of the session over the same logical plan."""
        dataset = self.spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
        dataset.createOrReplaceTempView(name)

    def query(self, sql: str, max_rows: int = 100, timeout: float = 5.0, scope: Scope = EVERYTHING) -> dict:
        """columns, rows (at most max_rows), truncated, elapsed_ms."""
        began, df = time.time(), self.plan(sql, scope)
        session, tag = df.sparkSession, f"sql-{uuid.uuid4().hex}"
        timer = threading.Timer(timeout, lambda: session.sparkContext.cancelJobsWithTag(tag) if hasattr(session.sparkContext, "cancelJobsWithTag") else None)
        timer.start()
        try:
            session.sparkContext.addJobTag(tag)
            rows = df.limit(max_rows + 1).collect()
        except Exception as e:
            if time.time() - began >= timeout:
                raise SqlTimeout(f"more than {timeout} s") from None
            raise SqlError(str(e).split("\n")[0]) from None
        finally:
            timer.cancel()
            session.sparkContext.removeJobTag(tag)
        return {"columns": df.columns, "rows": [[cell(v) for v in r] for r in rows[:max_rows]], "truncated": len(rows) > max_rows, "elapsed_ms": round((time.time() - began) * 1000)}


def cell(v):
    """A result cell: null, number, text; bytes as a count, values that aren't finite as null."""
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, bytes | bytearray):
        return f"<{len(v)} bytes>"
    return v if v is None or isinstance(v, bool | int | float | str) else str(v)


def to_text(result: dict) -> str:
    """A result as a text table."""
    cols = [[str(c), *["" if r[i] is None else str(r[i]) for r in result["rows"]]] for i, c in enumerate(result["columns"])]
    width = [max(map(len, c)) for c in cols]
    lines = [" | ".join(c[k].ljust(w) for c, w in zip(cols, width)).rstrip() for k in range(len(result["rows"]) + 1)]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:], *(["…"] if result["truncated"] else [])])


def to_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False)
