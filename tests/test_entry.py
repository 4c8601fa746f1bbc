"""The entry file works without the training-data subpackage, with or without the pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_subpackage(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    gone = shutil.ignore_patterns(".git", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=lambda d, names: {*gone(d, names), *({"llm"} & {*names})})
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "assert set(s) == set(q) and len(q) >= 84, (len(q), set(q) ^ set(s)); "
            "assert not [k for k in q if k[:2] == 'op' and k[2].isdigit() or k == 'pipeline']")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                          env={**os.environ, "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
