import numpy as np
import pyarrow as pa
import pytest

from quillbar.llm import tokens
from quillbar.llm.words import slices

VOCABULARY = "word_bpe_49k.json"


def test_numbers_find_what_was_added_among_collisions():
    rng = np.random.default_rng(3)
    # one slot for half of the hashes, so that most do not get their own
    hashes = np.unique(np.append(rng.integers(1, 2**62, 30_000, dtype=np.uint64), np.arange(1, 3000, dtype=np.uint64) << np.uint64(32)))
    rng.shuffle(hashes)
    known = tokens.Numbers()
    for part in np.array_split(hashes, 7):
        assert (known.find(part) == -1).all()
        known.add(part)
    assert (known.find(hashes) == np.arange(len(hashes))).all() and known.count == len(hashes)
    assert (known.find(hashes ^ np.uint64(1 << 63)) == -1).all() and known.find(hashes[:0]).tolist() == []
    assert len(known.keys) >= 2 * len(hashes)


@pytest.mark.parametrize("most", [1 << 20, 70])
def test_ids_are_those_of_the_tokenizer_and_the_cache_keeps_its_limit(monkeypatch, most):
    monkeypatch.setattr(tokens, "CACHE_WORDS", most)
    odd = ["", "it's a ﬁ İstanbul é áb ́c <|endoftext|> x<|endoftext|>y", None, "  ​z\x00q \x1c \x85 ǅ ẞ 12,5% 中文字", " \n ", "日本 don't"]
    column = pa.array(odd + [" ".join(f"w{i}{'é,.'[i % 3]}" for i in range(k, k + 30)) for k in range(0, 300, 10)])
    encoder = tokens.Encoder(tokens.vocabulary(VOCABULARY))
    for _ in range(2):
        got = []
        for _, _, texts in slices(column, 400):
            ids, bounds = encoder.encode(texts, 1)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            assert encoder.known.count <= most
        assert got == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in column.to_pylist()]
