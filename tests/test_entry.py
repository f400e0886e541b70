"""The driver's contract."""

import __spark_entry__ as entry

from terrapatch import registered


def test_names_and_sql():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(registered.QUERIES) > 80


def test_no_import_of_the_optional_subpackage():
    from pathlib import Path

    root = Path(registered.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "terrapatch.llm" not in path.read_text(), path
