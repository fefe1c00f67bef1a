"""Run registered queries beside their SQL: python tests/run_check.py SF_DIR [name ...]."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as entry
from checking import differences, rows_of, second_engine
from quillbar.session import local_session


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = second_engine(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)), "unknown:", sorted(set(sql) - set(queries)))
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - start
            if name not in sql:
                print(f"{name}: {len(got[1])} rows, {spent:.2f}s, no SQL", flush=True)
                continue
            cur = con.execute(sql[name])
            want = rows_of([c[0] for c in cur.description], cur.fetchall())
            diff = differences(got, want)
            types = [(f.name, f.dataType.simpleString()) for f in sorted(df.schema.fields, key=lambda f: f.name)]
            kinds = [str(c[1]) for c in sorted(cur.description, key=lambda c: c[0])]
            print(f"{name}: {len(got[1])} rows, {spent:.2f}s + {time.time() - start - spent:.2f}s {'OK' if not diff else 'DIFFERS'}", flush=True)
            same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
            for (n, t), k in zip(types, kinds):
                if same.get(t) != k:
                    print("   type", n, t, k)
            if diff:
                bad.append(name)
                for d in diff[:3]:
                    print("   ", str(d)[:600])
        except Exception as e:
            bad.append(name)
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)


main()
