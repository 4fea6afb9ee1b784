"""The benchmark's windows as arrays: memory, repeated items, brute force."""

import pickle
import random
import re

import pyarrow as pa


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    out = []
    for text in docs:
        w, hit, found = words_of(text), set(), set()
        for item_id, t in items:
            own = words_of(t)
            size = min(window, len(own))
            windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if size else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= {str(item_id)} - {"None"}
        out.append((sorted(hit), found))
    return out


def test_scan_against_brute_force():
    from presswork.llm.decontaminate import WindowSet, _words

    rnd = random.Random(6)
    for k in (2, 5, 60):
        vocabulary = [f"w{i}" for i in range(k)] + ["É", "日本"]
        text = lambda n: rnd.choice((" ", "-", "\n")).join(rnd.choice(vocabulary) for _ in range(n))
        items = [(i, text(rnd.randint(0, 30))) for i in range(25)]
        items += [(3, items[4][1]), (77, items[4][1]), (None, items[5][1]), (None, text(12)), (78, "only here"), (79, "W1")]
        docs = [text(rnd.randint(0, 80)) + " " + rnd.choice(items)[1].upper() + " " + text(3) for _ in range(40)] + ["", "only here"]
        words = _words(pa.array(docs))
        hit, found = WindowSet(items).scan(words)
        got = [([int(x) for x in hit[a:a + n].nonzero()[0]], f) for a, n, f in zip(words.first, words.count, found, strict=True)]
        assert got == brute(docs, items)


def test_size_by_words():
    from presswork.llm.decontaminate import WindowSet

    rnd = random.Random(1)
    items = [(i % 500, " ".join(f"x{rnd.randint(0, 30_000)}" for _ in range(40))) for i in range(5000)]
    held = WindowSet(items + items[:1000])
    assert len(pickle.dumps(held)) < 60 * 40 * 6000
    assert sum(len(known) for known, *_ in held.by_length.values()) <= 31 * 5000
