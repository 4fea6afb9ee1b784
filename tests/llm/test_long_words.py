"""Byte-level BPE of very long words against the tiktoken library."""

import base64
import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def both():
    import tiktoken

    from presswork.llm.byte_bpe import RANKS, vocabulary

    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), vocabulary(P.path(RANKS))


RND = random.Random(8)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORDS = {
    "letters": lambda n: "".join(RND.choices(LETTERS, k=n)),
    "one letter": lambda n: "a" * n,
    "two letters": lambda n: "ab" * (n // 2),
    "base64": lambda n: base64.b64encode(RND.randbytes(n * 3 // 4)).decode(),
    "han": lambda n: "".join(chr(RND.randint(0x4E00, 0x9FA5)) for _ in range(n // 3)),
    "english": lambda n: "".join(RND.choice(("the", "and", "press", "work", "ing", "tion", "quick", "x", "of", "in")) for _ in range(n // 3))[:n],
    "digits": lambda n: "".join(RND.choices("0123456789", k=n)),
    "signs": lambda n: "".join(RND.choices("!#=-_*", k=n)),
    "few letters": lambda n: "".join(RND.choices("etaoin", k=n)),
}


@pytest.mark.parametrize("kind", WORDS)
def test_long_word(both, kind):
    """A quarter of a megabyte of each kind within 15 s of CPU, equal to the library, and back."""
    from presswork.llm.byte_bpe import decode_batch, encode_batch

    library, vocab = both
    text = WORDS[kind](1 << 18)
    began = time.process_time()
    ids, ranges = encode_batch(pa.array([text, text[:5000]]), vocab)
    assert [t.decode() for t in decode_batch(ids, ranges, vocab)] == [text, text[:5000]]
    assert time.process_time() - began < 15
    # the library takes the square of a word's length: compared on pieces of its own
    for n in (97, 5000):
        ids, ranges = encode_batch(pa.array([text[:n]]), vocab)
        assert ids.tolist() == library.encode_ordinary(text[:n])


def test_pieces_give_the_ids_of_the_whole(both):
    """Pieces, cut once and again, against the contraction of the whole word, pair by pair."""
    _, vocab = both
    rnd = random.Random(2)
    for _ in range(60):
        word = "".join(rnd.choices(rnd.choice((LETTERS, "etaoin", "ab", "AaBb01", "日本語中国人", "0123456789", "ab", "=-")), k=rnd.randint(30, 120))).encode()
        toks = [bytes([b]) for b in word]
        while True:
            ranked = [(vocab.ranks[a + b], i) for i, (a, b) in enumerate(zip(toks, toks[1:])) if a + b in vocab.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            toks[i:i + 2] = [toks[i] + toks[i + 1]]
        want = np.array([vocab.ranks[t] for t in toks], "<u4").tobytes()
        assert vocab._long([word, word[:-1], word])[2] == want == vocab.encode([word])[0]


def test_memory_holds_no_long_words(both):
    from presswork.llm.byte_bpe import LONG_WORD

    _, vocab = both
    vocab.encode([b"q" * 5000, b"the", b"zx" * 60])
    assert all(len(w) <= LONG_WORD for w in vocab.memo) and all(len(r) <= 4 * LONG_WORD for r in vocab.decoded)
