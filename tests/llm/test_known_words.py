"""Words that a worker remembers from step to step."""

from __future__ import annotations

import pyarrow as pa

from quarry.llm.bpe import tokenizer_path
from quarry.llm.token_orc import LibraryCoder


def test_words_of_the_last_step_stay_when_the_memory_is_full():
    with open(tokenizer_path(), encoding="utf-8") as f:
        code = LibraryCoder(f.read())
    code.most_known = 40
    asked, own = [], code.merge_words
    code.merge_words = lambda words: asked.append(words) or own(words)
    common = [f"common{chr(97 + k)}" for k in range(10)]
    told = []
    for step in range(12):
        text = " ".join([*common, *(f"rare{chr(97 + step)}{chr(97 + k)}" for k in range(8))])
        told.append(code.encode(pa.array([text]), False)[0].tolist())
        assert len(code.known) <= 41  # the empty one beside them
    assert sum(w.startswith(b"common") for words in asked for w in words) == 10
    assert [x[: len(told[0]) // 4] for x in told] == [told[0][: len(told[0]) // 4]] * 12
