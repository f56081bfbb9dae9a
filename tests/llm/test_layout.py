"""The entry point beside a subpackage that cannot be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_where_a_library_is_missing(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not there')")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'exact_topk' in q and 'pipeline' not in q and set(o) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert "no training-data queries" in out.stderr
