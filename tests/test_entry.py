import math
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_the_problems_use_their_prefix():
    import re

    import __spark_entry__ as e

    assert {int(m[1]) for n in e.queries() if (m := re.match(r"p(\d+)_", n))} <= set(range(1, 11))


def test_core_does_not_import_the_text_subpackage():
    code = "import sys; from lodestone.plans import catalogue; catalogue.queries(); sys.exit(any(m.startswith('lodestone.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def _plain(x):
    """A value in a form that is equal for equal values of either engine."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"  # the last digits depend on the order of summation
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return str([_plain(v) for v in x])
    s = str(x)
    return "null" if s in ("NaT", "<NA>") else s


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_core_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from lodestone.plans import catalogue

    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    queries, sql = catalogue.queries(), catalogue.oracle()

    def compared(name):
        df = queries[name](spark, str(DATA))
        cur = con.cursor().execute(sql[name])
        names = [c[0] for c in cur.description]
        got, want = _rows(df.columns, df.collect()), _rows(names, cur.fetchall())
        if sorted(df.columns) != sorted(names):
            return name, sorted(df.columns), sorted(names)
        return (name, len(got), len(want), [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]) if got != want else None

    with ThreadPoolExecutor(6) as pool:
        wrong = [w for w in pool.map(compared, sorted(sql)) if w]
    assert not wrong
