"""The driver contract where a library of the text operators is absent."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import sys, warnings
sys.modules["{hidden}"] = None
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from heliodrift.catalog.oracle import ORACLE_SQL
from heliodrift.catalog.queries import QUERIES
assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLE_SQL
assert len(QUERIES) >= 60
"""


@pytest.mark.parametrize("hidden", ["tiktoken", "public_tokenizers", "heliodrift.llm.queries", "corpus_pipeline"])
def test_core_queries_stay_without_the_text_operators(hidden):
    code = CODE.format(hidden=hidden)
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_other_errors_are_not_hidden():
    code = "import sys; sys.modules['heliodrift.catalog.queries'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert "ModuleNotFoundError" in done.stderr or "ImportError" in done.stderr
