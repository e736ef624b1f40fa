"""Token counts of texts without places to cut, with the production chunk sizes."""

import base64
import random

import public_tokenizers
import pytest
from riskmill.llm.token_counts import CHUNK, Counter

PIECE = public_tokenizers.path("piece_bpe_32k.model")
PROSE = "The quick brown fox jumps over the lazy dog, and then it rests. " * 1100
_rng = random.Random(8)
RUNS = {
    "one character": "a" * 200_000,
    "base64": base64.b64encode(_rng.randbytes(150_000)).decode(),
    "cjk": "".join(chr(_rng.randrange(0x4E00, 0x5000)) for _ in range(70_000)),
    "lines": "\n".join("".join(_rng.choice("abcdef") for _ in range(40)) for _ in range(5000)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_runs_without_blanks_after_prose_count_as_the_whole(name):
    tool = Counter(PIECE)
    reads = []
    starts = tool.starts
    tool.starts = lambda text, lead: reads.append(len(text)) or (starts(text, lead) if len(reads) < 100 else pytest.fail("no end"))
    for text in (PROSE + RUNS[name] + PROSE, RUNS[name] + PROSE, PROSE + RUNS[name]):
        assert len(text.encode()) > 2 * CHUNK
        reads.clear()
        assert tool.count(text) == len(tool.model.encode(text))
