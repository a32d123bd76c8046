"""Sizes of the pieces of texts that are encoded at once."""

import pyarrow as pa

from kelpline.llm.word_encoder import slices


def test_slices_of_a_given_size():
    texts = pa.array(["a" * 9, None, "b" * 9, "c" * 40, "", "d" * 9])
    assert list(slices(texts, 20)) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(slices(texts, 1000)) == [(0, 6)] == list(slices(texts))
