"""The entry imports without the folder of training-data operators, with and without the pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 230 and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and not [k for k in q if k.startswith('op')]"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/levelscan", tmp_path / "levelscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
