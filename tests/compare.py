"""Run registered queries and their check SQL side by side."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(rows: list[tuple], order: list[int]) -> list[str]:
    def cell(value):
        if isinstance(value, float):
            return f"{value + 0.0:.6f}"
        return str(value)

    return sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)


def difference(spark, folder: str, name: str, run, check: str | None) -> tuple[str, float, float]:
    """'' if both sides agree, else what differs; and the seconds each side took."""
    start = time.time()
    frame = run(spark, folder)
    table = frame.toArrow()
    mine = list(zip(*[column.to_pylist() for column in table.columns])) if table.num_rows else []
    spark_time = time.time() - start
    if check is None:
        return ("" if mine else "no rows"), spark_time, 0.0
    start = time.time()
    cursor = connect(folder).execute(check)
    names = [item[0] for item in cursor.description]
    theirs = cursor.fetchall()
    sql_time = time.time() - start
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(names)}", spark_time, sql_time
    left = canonical(mine, sorted(range(len(frame.columns)), key=lambda i: frame.columns[i]))
    right = canonical(theirs, sorted(range(len(names)), key=lambda i: names[i]))
    if left == right:
        return ("" if left else "both empty"), spark_time, sql_time
    only = [x for x in left if x not in set(right)], [x for x in right if x not in set(left)]
    text = f"{len(left)} / {len(right)} rows; {len(only[0])} only here, {len(only[1])} only in SQL"
    return text + f"\n   here {only[0][:2]!r:.600}\n   SQL  {only[1][:2]!r:.600}", spark_time, sql_time


def main() -> None:
    from sluicegate.catalog import CHECKS, QUERIES
    from sluicegate.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            text, a, b = difference(spark, folder, name, run, CHECKS.get(name))
        except Exception as error:  # report and go on with the next query
            text, a, b = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0.0, 0.0
        bad += bool(text)
        kind = "sql" if name in CHECKS else "rows"
        print(f"{'ok ' if not text else 'BAD'} {name:28s} {kind:4s} {a:6.2f}s {b:6.2f}s {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
