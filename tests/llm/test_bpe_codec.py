import hashlib
import random
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe_codec
from folioscope.llm.bpe_codec import Codec, Decoder, MergeTransducer, Run, bpe_tokens, default_path, digests
from tests.llm.helpers import documents, texts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return t


def inputs():
    rng = random.Random(6)
    odd = ["a" * 700, "İstanbul ΑΣ ς", "<|endoftext|>a<|startoftext|><|x", "it's we'll'd 'Str x\x1cy\x85z", "１２ ½ ²x٣ \U0001f600\U0001d7d8", "e\u0301 한국어 नमस्ते", "\u00a0\u3000 \u2028x", "___--__", "'" * 70]
    runs = ["".join(rng.choice(["th", "in", "er", "on", "a", "b", "ing", "é", "ß", "漢"]) for _ in range(rng.randint(30, 600))) for _ in range(60)]
    return texts(n=10) + odd + runs + [("word " * 70_000) + "end", "thing" * 60_000, "-'x" * 40_000, "é" * 150_000]


def test_same_as_the_library(spark, library):
    rows = inputs()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_tokens(documents(spark, rows, extra=["ids", "n_tokens"])).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t[:40]


def test_run_holds_a_bounded_window_and_equals_the_merge():
    t = Codec(default_path()).transducer
    rng = random.Random(8)
    for _ in range(60):
        word = "".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(1, 300))).encode()
        assert t.encode(word) == t.merge(t.symbols(word))
    words = ["".join(rng.choice(["a", "b", "th", "in", "é", "ing", "\u6f22", "'", "aa"]) for _ in range(rng.randint(0, 12))).encode() for _ in range(3000)]
    assert [list(array("I", x)) for x in t.encode_many(words)] == [t.merge(t.symbols(w)) for w in words]
    pairs = rng.choices(sorted(t.spell), k=4000)
    fits = t.fits_many(np.array(pairs[::2]), np.array(pairs[1::2])).tolist()
    assert t.regular and fits == [t.fits(a, b) for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    run, most, emitted = Run(t), 0, 0
    for _ in range(5000):
        emitted += sum(len(t.spell[i]) for i in run.push(b"thinging"))
        most = max(most, len(run.window))
    emitted += sum(len(t.spell[i]) for i in run.finish())
    assert emitted == 40_000 and most < 12 * t.lookahead()


def test_windows_do_not_show(library, monkeypatch):
    """Tiny windows over texts without white space, with marks, quotes and letters of many scripts at every cut."""
    monkeypatch.setattr(bpe_codec, "CHUNK", 8)
    codec, rng = Codec(default_path()), random.Random(9)
    alphabet = ["a", "b", "'s", "'", "'ll", "--", "é", "e\u0301", "漢", "9", " ", "한", "\u1112\u1161\u11ab", "Σ", "n\u0303\u0323", "\U0001f600", "x" * 30, "-" * 30]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_the_query_goes_through_the_transducer_and_the_decoder(monkeypatch):
    codec, pushed, fed = Codec(default_path()), [], []
    push, feed = Run.push, Decoder.feed
    monkeypatch.setattr(Run, "push", lambda self, more: (pushed.append(bytes(more)), push(self, more))[1])
    monkeypatch.setattr(Decoder, "feed", lambda self, ids: (fed.append(len(ids)), feed(self, ids))[1])
    many, encode = [], MergeTransducer.encode_many
    monkeypatch.setattr(MergeTransducer, "encode_many", lambda self, words: (many.extend(words), encode(self, words))[1])
    digest = digests(codec, ["the cat <|endoftext|> sat " + "x" * 40, "the"])
    assert sorted(many) == [b"cat", b"sat", b"the"] and pushed == [b"x" * 40] and sum(fed) == digest[0][0] + digest[1][0]


def test_decoder_is_incremental():
    codec = Codec(default_path())
    ids = codec.encode("Héllo wörld \U0001f600 it's")
    for mode in ("pieces", "text"):
        whole, steps = Decoder(codec.transducer, mode), Decoder(codec.transducer, mode)
        assert whole.feed(ids) + whole.finish() == "".join(steps.feed([i]) for i in ids) + steps.finish()
    decoder = Decoder(codec.transducer, "text")
    assert decoder.feed(ids) + decoder.finish() == "héllo wörld \U0001f600 it 's "


def test_outputs_nulls_and_empty(spark):
    rows = bpe_tokens(documents(spark, [(1, "the cat"), (1, "the cat"), (None, None)]), with_output=True).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"])) for r in rows) == [(0, "", 0), (1, "the</w> cat</w>", 2), (1, "the</w> cat</w>", 2)]
    assert bpe_tokens(documents(spark, ["x"]).limit(0)).collect() == []
