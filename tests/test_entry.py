import importlib
import re
from pathlib import Path

import pluvio


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_corpus_operators():
    root = Path(pluvio.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+pluvio\.llm", path.read_text()), path
            importlib.import_module(".".join(["pluvio", *path.relative_to(root).with_suffix("").parts]))
