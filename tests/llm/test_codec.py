import os
import random

import numpy as np
import pytest

from tracehound.llm import token_codec as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_code_is_optimal_and_limited():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 300):
        counts = {s: int(rng.paretovariate(0.5)) + 1 for s in range(n)}
        for limit in (9, 12, 40):
            lengths = tc.code_lengths(counts, limit)
            assert set(lengths) == set(counts) and max(lengths.values()) <= limit
            assert n == 1 or sum(2.0 ** -b for b in lengths.values()) == 1.0  # complete: nothing wasted
        # without a binding limit: the cost of a plain Huffman code
        import heapq
        heap, cost = list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        if n > 1:
            assert sum(counts[s] * b for s, b in lengths.items()) == cost
    with pytest.raises(ValueError):
        tc.code_lengths({s: 1 for s in range(20)}, 4)


def test_round_trip_and_single_blocks():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 5000), 40_000).astype(np.uint32)
    u, n = np.unique(ids, return_counts=True)
    code = tc.Code(tc.code_lengths(dict(zip(u.tolist(), n.tolist()))))
    for size in (0, 1, 511, 512, 513, 5000):
        payload, marks = code.encode(ids[:size])
        assert len(marks) == -(-size // tc.BLOCK_IDS)
        assert (code.decode(payload, marks, size) == ids[:size]).all()
    payload, marks = code.encode(ids)
    one = code.decode(payload, marks[3:4], tc.BLOCK_IDS)  # any block by itself
    assert (one == ids[3 * tc.BLOCK_IDS:4 * tc.BLOCK_IDS]).all()


def test_encoder_is_the_library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    texts = ["", " ", "  ", "it's 5 o'clock  \n\n  x", "a b 漢字 ２", "  lead", "trail  ", "''s ’s <|endoftext|> z", "\t\ttabs\r\n\x0b x",
             "a   b", "x. \nY \n z", "a\n\nb c", "x <|endoftext|> z", "<|endoftext|>", "a<|endoftext|>b c d", "é ñ ª º ² ½ Ω   x", "word, word. (word) word's", "x " * 300]
    enc = tc.TextEncoder.of(BPE)
    enc.generation = 3  # the memo turns over all the time
    for _ in range(3):
        got = [np.frombuffer(x, enc.dtype).tolist() for k in range(0, len(texts), 4) for x in enc.encode(texts[k:k + 4])]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    del tc.TextEncoder._shared[BPE]


def test_pieces_are_put_together_from_known_words():
    """A known word with marks or a line feed isn't encoded anew, and the ids are the library's."""
    from tokenizers import Tokenizer
    encoder, plain = tc.TextEncoder(BPE), Tokenizer.from_file(BPE)
    texts = ["x zorbel qwilm Éclat", "a zorbel. zorbel,\nqwilm zorbel.\nÉclat$$$ zorbel's zorbel'\ns qwilm.\n\nzorbel zorbel' zorbel.qwilm", "zorbel.\nzorbel",
             "a qwilm..\nzorbel! qwilm\nzorbel_ zorbel5. qwilm.\n5 zorbel\u00aa. \u00d7zorbel zorbel\u0149s zorbel ", "b zorbel.' zorbel'\nre zorbel\n're", " ", "a ", ""]
    for t in texts + [" ".join(texts[1:3])]:
        got, = encoder.encode([t])
        assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids
    asked, library = [], encoder.library
    encoder.library = lambda x: asked.extend(x) or library(x)
    encoder.encode(["a zorbel; qwilm!\nzorbel Éclat..."])
    assert not any("zorbel" in x or "qwilm" in x or "clat" in x for x in asked)


def test_words_are_looked_up_once_for_many_texts():
    """The memo is asked for the distinct pieces of a slice of texts, not for every word, and a
    word before any marks is the known word."""
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    encoder = tc.TextEncoder(BPE)
    first, = encoder.encode(["a zorbel, qwilm\nzorbel"])
    encoder.memo = Counted(encoder.memo)
    asked, library = [], encoder.library
    encoder.library = lambda x: asked.extend(x) or library(x)
    got = encoder.encode(["a zorbel, qwilm\nzorbel"] * 2000 + ["a zorbel(qwilm\nzorbel.. zorbel,5 qwilm)"])
    assert got[:2000] == [first] * 2000 and encoder.memo.asked < 50
    assert not any("zorbel" in x for x in asked) and max(map(len, asked)) < 10


def test_the_library_gets_short_runs():
    """What is held while the library encodes unknown words doesn't grow with the texts."""
    from tokenizers import Tokenizer
    encoder, plain = tc.TextEncoder(BPE), Tokenizer.from_file(BPE)
    texts = [" ".join(f"w{chr(97 + k % 26)}{k}x\ny{k}" for k in range(j, j + 500)) for j in range(0, 10_000, 500)] + [f"漢字 {k}" for k in range(1000)]
    calls, library = [], encoder.library
    encoder.library = lambda x: calls.append(sum(map(len, x))) or library(x)
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert max(calls) <= 20 * tc.ASKED
    assert "漢字 7" in encoder.memo and not any(len(p) > encoder.longest for p in encoder.memo)


def test_cuts_agree_with_the_library():
    """Random texts of letters, marks, digits and blanks of all kinds, and every character up to U+024F."""
    from tokenizers import Tokenizer
    encoder, plain, rng = tc.TextEncoder(BPE), Tokenizer.from_file(BPE), random.Random(5)
    encoder.generation = 500
    plainly = ["a", "Zo", "the", "s", "'", "'ll", "..", ",", "$", "_", " a", " .", " ", "\n", "é", "×", "÷", "ª", "²", "½", "ɏ", "12", " é", " ×", "ŉ", "ß", "«"]
    oddly = ["ɐ", "\xa0", "\x85", "\xad", "漢", "<|endoftext|>", "<|", "\t", "  ", "\x7f", "\r", "\u2028", "\U0001f600", "\n\n", "\0"]
    allowed = ["\n", *map(chr, range(0x20, 0x7f)), *map(chr, range(0xa1, 0x250))]
    texts = ["".join(rng.choice(plainly + oddly * (k % 2)) for _ in range(rng.randint(0, 12))) for k in range(6000)]
    texts += [f"x y{c}z{c}.{c}' w {c}a{c}{d}{c}s" for c in allowed for d in "'.\n5×"]
    got = [np.frombuffer(x, encoder.dtype).tolist() for k in range(0, len(texts), 50) for x in encoder.encode(texts[k:k + 50])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_slices_hold_all_rows(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tc, "TEXT_BYTES", 10)
    texts = ["", "four", None, "x" * 35, "é" * 6, "", "a", "b", "c" * 8, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    got = list(tc.slices(iter([batch.slice(0, 0), batch.slice(0, 4), batch.slice(4)])))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert [i for b in got for i in b.column("doc_id").to_pylist()] == list(range(10))
    assert all(len(b) and sum(len((t or "").encode()) for t in b.column("text").to_pylist()[1:]) <= 10 for b in got) and len(got) == 4
    encoder = tc.TextEncoder(BPE)  # a slice of an array, with a null text
    assert [encoder.ids(b.column("text"))[1].tolist() for b in got][0] == [0, *[len(encoder.encode(["four"])[0]) // 2] * (len(got[0]) - 1)]


def test_files(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    rows = [(k * 7 % 101, " ".join(rng.choice(["alpha", "beta,", "gamma.", "été"]) for _ in range(rng.randint(0, 300)))) for k in range(101)]
    path = os.path.join(tmp_path, "ids")
    tc.write_ids(make_docs(rows), path, BPE)
    got = {r.doc_id: r for r in tc.read_ids(spark, path).collect()}
    at = 0
    for doc, text in sorted(rows):
        want = t.encode(text, add_special_tokens=False).ids + [tc.END_ID]
        assert got[doc].ids == want and got[doc].start == at and got[doc].n_tokens == len(want)
        at += len(want)
