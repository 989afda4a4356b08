"""Single windows that agree in a part of their rank are told apart."""

import numpy as np
import pyarrow as pa
import pytest

from redactlake.llm import repeats


class Colliding(repeats.Ranks):
    """Ranks of the first kind that agree in all but their lowest bits."""

    def __init__(self, data, *kind):
        super().__init__(data, *kind)
        self.weak = not kind

    def at(self, begin, end):
        x = super().at(begin, end)
        return x & np.uint64(0xF) if self.weak else x


@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_second_round(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "Ranks", Colliding)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdef"), 90)) for _ in range(6)]
    texts[4] = texts[1][:60] + texts[4][:30]
    chunks = list(repeats._packed([pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])], chunk))
    rows = []
    for c in chunks:
        n = len(c.column("ids")[0].as_py()) // 8
        asked = repeats.pack(np.arange(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32), np.full(n, 40, dtype=np.uint8))
        rows += repeats._second_round(50, 1)([c.append_column("asked", pa.array([[{"bucket": 0, "rows": asked}]]))])
    found = repeats._windows_of_bucket(pa.Table.from_batches(rows).cast(repeats._OUT_ARROW))
    ids = {c.column("chunk")[0].as_py(): np.frombuffer(c.column("ids")[0].as_py(), dtype="<i8") for c in chunks}
    got = set()
    for k, blob in zip(found.column("chunk").to_pylist(), found.column("rows").to_pylist(), strict=True):
        doc, place, more = repeats.unpack(blob)
        got |= {(int(ids[k][d]), int(p)) for d, p in zip(doc, place, strict=True)}
    assert got == {(4, p) for p in range(11)}
