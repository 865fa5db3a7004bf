"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_parts():
    """Without the optional subpackage and the pipeline the rest still imports."""
    code = "import sys; sys.modules['catalograph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
