import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print('\\n'.join(sorted(e.queries()))); print('--'); print('\\n'.join(sorted(e.oracle_sql())))"


def listed(folder):
    run = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return tuple({x for x in part.split("\n") if x} for part in run.stdout.split("--"))


def test_queries_without_the_language_model_operators(tmp_path):
    """The rest of the library keeps its queries whatever of the llm folders and the pipeline is installed."""
    of_llm = {n for n in listed(ROOT)[0] if n.startswith("op") or n == "pipeline"}
    for gone in (["barloom/llm", "tests/llm"], ["barloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]):
        copy = tmp_path / str(len(gone))
        shutil.copytree(ROOT, copy, ignore=lambda d, names, gone=gone: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in gone])
        left = of_llm if gone != ["corpus_pipeline.py"] else {"pipeline"}
        for with_llm, without in zip(listed(ROOT), listed(copy)):
            assert without == with_llm - left
