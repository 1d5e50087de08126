import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_oracles_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_the_rest_works_without_the_training_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine_topk' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "fathom")):
        if os.path.basename(top) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(top, n)) as f:
                    assert "fathom.llm" not in f.read(), n
