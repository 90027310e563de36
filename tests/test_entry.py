"""The driver's contract: what is registered."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_every_operator_is_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in found and e.oracle_sql().keys() <= found.keys()


@pytest.mark.parametrize(("gone", "left"), [("plumbline.llm", "False"), ("plumbline.llm.search", "error")])
def test_only_a_missing_part_is_left_out(gone, left):
    """Without the operators the rest is registered; an operator that cannot be imported is an error."""
    code = f"import sys; sys.modules['{gone}'] = None\nimport __spark_entry__ as e\nprint('pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert (done.stdout.strip() if done.returncode == 0 else "error") == left, done.stderr
