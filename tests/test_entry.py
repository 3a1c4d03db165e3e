"""The registered queries."""

import __spark_entry__
from ledgerlake.plans import core


def test_core_is_registered():
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_in_the_core_imports_the_text_subpackage():
    import re
    from pathlib import Path

    root = Path(core.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
