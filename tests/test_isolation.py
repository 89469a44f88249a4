"""Everything but the training-data operators has to work without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'wordcount' in q, any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [["millrace/llm", "tests/llm"], ["millrace/llm", "tests/llm", "corpus_pipeline.py"]])
def test_a_copy_without_the_optional_folders_lists_its_queries(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[Path(g).name for g in gone if g.endswith(".py")]))
    for g in gone:
        if (copy / g).is_dir():
            shutil.rmtree(copy / g)
    said = subprocess.run([sys.executable, "-c", LISTED], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 100 and said[1:] == ["True", "False", "True"]
