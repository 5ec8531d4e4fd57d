"""The driver's contract holds with and without the training-data operators and what they need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["ahocorasick", "postlake.llm", "corpus_pipeline"])
def test_missing_modules_take_only_their_own_queries(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'flagship' in q and len(q) > 70 and 'pipeline' not in q; print('op1_licenses' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert missing == "corpus_pipeline" or out.stdout.strip() == "False"
