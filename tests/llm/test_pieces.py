import os
import random

import pytest

from placewright.llm.pieces import MODEL, SIDE_BY_SIDE, DoubleArray, Pieces, encode
from tests.llm.helpers import documents, odd_rows

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model")


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as file:
        return Pieces(file.read())


def whole(pieces, text):
    """Viterbi over a whole text, from a dictionary: the ids, and their score."""
    import sentencepiece

    given = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    scores = {given.id_to_piece(int(i)): (s, int(i)) for i, s in zip(pieces.ids, pieces.scores)}
    chars = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, [])] + [(float("-inf"), [])] * len(chars)
    for i in range(len(chars)):
        for j in range(i + 1, min(len(chars), i + 16) + 1):
            if (found := scores.get(chars[i:j])) and best[i][0] + found[0] > best[j][0]:
                best[j] = best[i][0] + found[0], [*best[i][1], found[1]]
        if chars[i] not in scores and best[i][0] + pieces.unknown > best[i + 1][0]:
            best[i + 1] = best[i][0] + pieces.unknown, [*best[i][1], *(int(pieces.byte_ids[b]) for b in chars[i].encode())]
    return best[-1][1]


def test_double_array():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab\xff\x01z") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    trie = DoubleArray(keys)

    def find(key):
        state = 0
        for byte in key:
            following = trie.base[state] + byte
            if trie.check[following] != state:
                return -1
            state = following
        return trie.value[state]

    assert all(find(k) == i for i, k in enumerate(keys))
    others = [bytes(rng.choice(b"ab\xff\x01z") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    assert all((find(k) >= 0) == (k in set(keys)) for k in others)


def test_against_viterbi_over_the_whole_text(pieces):
    rng = random.Random(2)
    parts = ["the", "thing", "érable", "Straße", "☃", "\n", "\t", " ", "  ", "     ", "xq", "中文", "😀", "antidisestablishment", "\x00", "a" * (SIDE_BY_SIDE + 9)]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        ids, offsets = pieces.encode_texts([text, "other", text])
        first, last = ids[offsets[0] : offsets[1]].tolist(), ids[offsets[2] : offsets[3]].tolist()
        assert first == last == whole(pieces, text)
        assert pieces.decode(ids[offsets[0] : offsets[1]]) == text


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = encode(docs).collect()
    assert len(got) == len(odd_rows()) and all(r.intact and r.n_pieces == len(r.ids) for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    marked = encode(documents(spark, [(1, "a▁b", "s")])).first()
    assert not marked.intact
    assert encode(docs.limit(0)).count() == 0
