"""Nothing outside the subpackage of training-data operators imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_llm_stands_alone():
    for p in (ROOT / "trekmill").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
