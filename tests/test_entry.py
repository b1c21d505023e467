"""The driver's contract, with and without the training-data part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(e.__file__).parent
HIDE = """
import sys
sys.modules["tracepath.llm"] = sys.modules["corpus_pipeline"] = None  # neither can be imported
import __spark_entry__ as e
q = e.queries()
assert q and not any(n.startswith("op") or n == "pipeline" for n in q), q
assert set(e.oracle_sql()) <= set(q)
assert not any(m.startswith("tracepath.llm.") for m in sys.modules)
"""


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_part():
    subprocess.run([sys.executable, "-c", HIDE], cwd=REPO, check=True, timeout=120)
