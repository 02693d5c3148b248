from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def texts() -> dict:
    """Null, empty, white space, ties, near and exact copies, periodic and long texts, odd characters."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "é", "ß", "ou"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(60)
    out = {1: None, 2: "", 3: " \t\n\r\x0b\x0c ", 4: "one", 5: "One two\nthree", 6: base, 7: base, 8: base.replace(" an ", " AN "), 9: prose(80) + " " + passage + "\n" + prose(30), 10: passage + " " + prose(50), 11: "ab " * 400, 12: ("line of words here\n" * 30) + prose(12), 13: prose(4000), 14: "x" * 5000, 15: "\x00\x01 zero   wide   gap 𝔘nicode 🎉 end"}
    words = base.split()
    for i in range(16, 40):
        w = list(words)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        out[i] = " ".join(w)
    out[40] = "The and " + "## | $$ %% " * 40
    return out
