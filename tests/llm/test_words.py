import tracemalloc

import numpy as np
import pyarrow as pa

from quillbar.llm import quality_rules, words


def test_memory_of_a_scan_follows_a_small_slice():
    column = pa.array(["some words of a text that is not long, and more of them " * 20] * 3500)
    quality_rules.measure(next(words.slices(column))[2])
    tracemalloc.start()
    for _, _, texts in words.slices(column):
        quality_rules.measure(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_powers_for_larger_slices_are_kept_up_to_their_limit(monkeypatch):
    monkeypatch.setattr(words, "_powers", {})
    small = words._powers_of(0, 10)
    large = words._powers_of(0, words.KEPT_BYTES + 1)
    assert len(small[0]) == words.SLICE_BYTES + 1 and words._powers_of(0, 10)[0] is large[0]
    assert (large[0][:len(small[0])] == small[0]).all() and (large[0] * large[1] == np.uint64(1)).all()
    assert len(words._powers_of(0, words.KEPT_BYTES + 2)[0]) > len(large[0]) and words._powers_of(0, 10)[0] is large[0]
