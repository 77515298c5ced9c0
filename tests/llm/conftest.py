import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
# the operators are optional: without them there is nothing to test here
pytest.importorskip("breathline.llm")
