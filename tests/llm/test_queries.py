"""Queries of the subpackage against their SQL, and that nothing else needs it."""

import subprocess
import sys
from pathlib import Path

import pytest

from inkfield.llm import queries
from tests.compare import assert_same, connection

ROOT = Path(__file__).parents[2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        assert_same(df, queries.SQL[name], connection(data))
    else:
        assert df.count() > 0 or name == "p8_sets"


def test_columns(spark, data):
    want = {"p1_found": ["batch_id", "row_id"], "p2_found": ["example_a", "example_b"], "p3_found": ["row_id"], "p4_found": ["row_id"], "p8_found": ["doc_a", "doc_b"]}
    assert {n: queries.QUERIES[n](spark, data).columns for n in want} == want


def test_nothing_else_imports_it():
    other = [p for p in (ROOT / "inkfield").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in other if "inkfield.llm" in p.read_text()]
    code = "import sys; sys.modules['inkfield.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'p1_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1] == "False"
