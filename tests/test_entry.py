"""The entry without the training-data operators, and without a module that they need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def listed(blocked: str) -> tuple[set[str], str]:
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules.update(dict.fromkeys({blocked.split()!r})); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    return set(ran.stdout.split()), ran.stderr


def test_entry_without_what_is_missing():
    engine, said = listed("kmerloom.llm corpus_pipeline")
    assert len(engine) > 90 and "left out" in said and not any(n.startswith("op") for n in engine)
    if not (ROOT / "kmerloom/llm").exists():
        return
    other, said = listed("public_tokenizers")
    assert other == engine and "public_tokenizers" in said
    assert "pipeline" not in listed("corpus_pipeline")[0]
