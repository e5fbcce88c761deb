"""Windows that a task holds before it hands them on."""

import types

import numpy as np
import pyarrow as pa
import zstandard

from guidemill.llm import repeats


def test_a_task_hands_on_windows_in_small_blocks():
    """1.6 million candidate windows never stand in one block."""
    full = types.SimpleNamespace(value=[zstandard.compress(np.full(1 << 13, 255, np.uint8).tobytes())])
    texts = [" ".join(str(400_000 * i + k) for k in range(400_000)) for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["id", "text"])
    sizes = [sum(len(repeats._expand(x, "<i8")) for x in out.column("id").to_pylist()) for out in repeats._send(full, 1, 16, 2)(iter([batch]))]
    assert sum(sizes) == 1_600_000 and max(sizes) <= 1_200_000
