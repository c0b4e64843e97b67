"""Short items: a copy with any one word replaced is found, also where the text begins or ends with it."""

import pyarrow as pa
import pytest

from lexigraph.llm import decontamination as dc


@pytest.mark.parametrize("words", range(dc.LEAST, 10))
def test_any_word_replaced(words):
    item = [f"w{i}" for i in range(words)]
    copies = [item, *([*item[:i], "other", *item[i + 1 :]] for i in range(words)), item[1:], item[:-1]]
    texts = [" ".join(x) for c in copies for x in (c, ["some", *c, "more"])]
    apart = [" ".join([*item[:1], "other", "others", *item[3:]]), "nothing of it here at all"]
    got = dc.Block([7], [" ".join(item)]).overlaps(pa.array(texts + apart))
    assert sorted(row for row, _ in got) == list(range(len(texts)))
