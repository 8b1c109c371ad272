import subprocess
import sys

import pytest

HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Hidden())
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(len(entry.queries()), any(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""


def listed(name):
    run = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], capture_output=True, text=True)
    return run.stdout.split(), run.stderr


def test_queries_without_a_library_of_the_text_package():
    for name in ("zstandard", "corpus_pipeline"):
        (count, text), _ = listed(name)
        assert int(count) > 90 and text == "False"


def test_a_missing_module_of_the_library_is_an_error():
    pytest.importorskip("tickloom.llm")
    out, error = listed("tickloom.llm.columns")
    assert not out and "No module named" in error
