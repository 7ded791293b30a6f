"""Every registered query of the library's own operators: against its SQL, or for its rows."""

from __future__ import annotations

import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, values):
    return sorted((tuple(plain(v) for v in r) for r in values), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, data, con, name):
    got = registry.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    mine = rows(cols, got.select(*cols).collect())
    if name not in registry.ORACLES:
        assert mine or name in ("ltt_certificate",)
        return
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = rows(cols, ([(float(x) if type(x).__name__ == "Decimal" else x) for x in (r[i] for i in at)] for r in want.fetchall()))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, int | float) and isinstance(y, int | float) and math.isclose(x, y, abs_tol=2e-5), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert {r["strategy"] for r in __spark_entry__.entry(spark).collect()} == {"none", "aggressive", "naive"}


def test_without_the_training_data_operators(tmp_path):
    """The entry module works where that subpackage and the pipeline are gone."""
    import shutil

    root = Path(__file__).parent.parent
    shutil.copytree(root / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80 and 'pipeline' not in q"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_nothing_imports_the_training_data_operators():
    root = Path(__file__).parent.parent / "palimpsest"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b|corpus_pipeline", p.read_text()), p
