"""Driver contract: every query registered, oracles only for registered keys,
and a sample of oracle comparisons on sf0.001."""
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pricewise.sources.testdata import TABLES

SMOKE = "/root/testdata/sf0.001"


def test_registry_shape():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 60


def test_library_stands_without_the_llm_folders(tmp_path):
    """The entry must import, and the other queries stay, where those folders are absent."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op')]; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert int(out.stdout.split()[-1]) >= 60


@pytest.mark.parametrize("key", ["d2_holdout", "t1_folds", "f6_vocab", "r3_topk", "e15_schema", "l3_counts",
                                 "v7_qq", "v8_permutation", "p4_predictions", "r9_overlay"])
def test_oracle_sample(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    sdf = entry.queries()[key](spark, SMOKE)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_n(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    o = sorted((tuple(_n(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert s == o


def _n(v):
    if isinstance(v, float):
        return round(v, 6)
    return v
