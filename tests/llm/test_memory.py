"""Memory of Python workers: what they hold at a time is bounded, whatever the input."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pagewatch.llm import toxicity
from pagewatch.llm.common import slices


def test_features_of_a_slice_take_little_memory():
    texts = ["".join(map(chr, np.random.default_rng(n).integers(97, 123, 2_000))) for n in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])
    whole = toxicity._features(texts, None)
    tracemalloc.start()
    found, start = [], 0
    for part, group in slices(batch, size_limit=toxicity.SLICE):
        rows, features = toxicity._features(group, None)
        found.append(np.stack([rows + start, features]).astype(np.int32))
        start += part.num_rows
    held = sum(f.nbytes for f in found)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert peak < 60e6
    assert (np.concatenate(found, axis=1) == np.stack(whole)).all()
