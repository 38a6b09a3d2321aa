"""The core never imports the text operators."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_llm():
    for path in (ROOT / "paneloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path
