import sys
from pathlib import Path

import pytest

pytest.importorskip("quarry.llm.queries")
sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]
