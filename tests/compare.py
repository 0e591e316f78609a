"""Side-by-side run of a catalogue query and its oracle SQL."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidewatch.plans.bindings import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_frame, con, sql: str) -> str | None:
    mine = canonical(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    result = con.execute(sql)
    theirs = canonical([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}; {mine[1][:2]} / {theirs[1][:2]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"first difference {a} != {b}"
    types = [(f.dataType.simpleString(), f.name) for f in spark_frame.schema]
    kinds = {d[0]: str(d[1]) for d in con.execute(sql).description}
    wide = {"bigint": ("BIGINT", "NUMBER"), "double": ("DOUBLE", "NUMBER"), "int": ("INTEGER", "NUMBER")}
    for kind, name in types:
        if kind in wide and kinds[name] not in wide[kind]:
            return f"type of {name}: {kind} / {kinds[name]}"
    return None


def main(names: list[str], sf_dir: str) -> int:
    from tests.conftest import make_session
    from tidewatch.plans.catalog import all_oracle_sql, all_queries

    spark, con, bad = make_session(), connect(sf_dir), 0
    queries, oracle = all_queries(), all_oracle_sql()
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracle:
                problem = difference(frame, con, oracle[name])
            else:
                rows = frame.collect()
                problem = None
                print("   ", rows[:2])
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in oracle else ' (rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    sys.exit(main([a for a in sys.argv[1:] if not a.startswith("/")], sf) > 0)
