"""Run registered queries and their SQL side by side.

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, floats and ints told apart."""

    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    rows = [tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows)


def kinds(spark_schema, duck_types) -> list[str]:
    """Columns whose types differ between the two sides."""
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    }
    return [
        f"{f.name}: {f.dataType.simpleString()} / {duck_types.get(f.name)}"
        for f in spark_schema.fields
        if names.get(f.dataType.simpleString(), "?") != duck_types.get(f.name)
    ]


def compare(spark, sf_dir: str, build, sql: str, connection) -> list[str]:
    """What differs between a query and its SQL; empty if nothing does."""
    result = build(spark, sf_dir)
    rows = result.collect()
    ours = pd.DataFrame([tuple(r) for r in rows], columns=result.columns, dtype=object)
    relation = connection.sql(sql)
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    theirs = pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object)
    problems = []
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"]
    problems += kinds(result.schema, types)
    left, right = normal(ours), normal(theirs)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    elif not left:
        problems.append("no rows")
    elif left != right:
        wrong = [(a, b) for a, b in zip(left, right) if a != b]
        a, b = wrong[0]
        cells = [(x[:80], y[:80]) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(wrong)} of {len(left)} rows differ, e.g. {cells}")
    return problems


def main() -> None:
    from tests.conftest import new_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, connection = new_session(), connect(sf_dir)
    failures = 0
    for name in wanted:
        started = time.time()
        try:
            if name in entry.oracle_sql():
                problems = compare(spark, sf_dir, entry.queries()[name], entry.oracle_sql()[name], connection)
                state = "; ".join(problems) or "ok"
            else:
                state = f"rows only: {entry.queries()[name](spark, sf_dir).count()}"
                problems = []
        except Exception as error:  # noqa: BLE001
            problems, state = [error], f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problems)
        print(f"{time.time() - started:6.2f}s {name}: {state}", flush=True)
    print(f"{failures} of {len(wanted)} failed")


if __name__ == "__main__":
    main()
