"""The driver's entry without the part that can be taken out, and with one of its libraries missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

COUNT = """
import sys, warnings
sys.path.insert(0, {root!r})
{before}
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
    said = [str(w.message) for w in said if "is left out" in str(w.message)]
names = entry.queries()
assert set(entry.oracle_sql()) <= set(names)
print(len(names), "score_search" in names, any(n.startswith("op") for n in names), said)
"""


def run(before=""):
    code = COUNT.format(root=str(ROOT), before=before)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/", check=True)
    return done.stdout.strip()


def test_main_queries_stand_alone():
    """As if the folder were deleted: its import fails by its own name, without a word."""
    found = run("sys.modules['staylens.llm'] = None")
    assert found.split(" ", 1)[1] == "True False []"


@pytest.mark.skipif(not (ROOT / "staylens" / "llm").exists(), reason="the part is taken out")
def test_a_missing_library_leaves_the_main_queries():
    found = run("sys.modules['xxhash'] = None")
    count, rest = found.split(" ", 1)
    assert int(count) > 60 and rest.startswith("True False") and "xxhash" in rest
