"""op1: encoding and decoding against the tokenizers library."""

import hashlib
import random
import struct

import numpy as np
from public_tokenizers import path as vocab
from tokenizers import Tokenizer

from terrapatch.llm import bpe, queries, words

from .conftest import SF, odd_texts

PATH = vocab("byte_bpe_50k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def agree(found, rows):
    t = reference()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in found), key=key) == sorted((expected(t, r[0], r[1]) for r in rows), key=key)


def test_whole_table(spark, documents):
    agree(queries.op1_bpe(spark, SF).collect(), documents.select("doc_id", "text").collect())


def test_odd_rows(odd):
    agree(bpe.round_trip(odd, PATH).collect(), odd.select("doc_id", "text").collect())


def test_empty_table(empty):
    assert bpe.round_trip(empty, PATH).collect() == []


def test_random_unicode():
    r = random.Random(5)
    alphabet = "aab \n\t'.,sStre0129éÀß中  😀́-_"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(400)]
    t, v = reference(), bpe.vocabulary(PATH)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    got = [[] for _ in texts]
    for row, ids in bpe.encode_rows(bpe.Encoder(v, None), data, offs):
        got[row] += ids.tolist()
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_of_long_texts(monkeypatch):
    """A text cut into pieces has the ids of the whole."""
    from terrapatch.llm import common

    text = odd_texts()[15]
    data = np.frombuffer(text.encode(), np.uint8)
    plain = common.pieces
    monkeypatch.setattr(common, "pieces", lambda d, o: plain(d, o, 1000))
    got = [i for _, ids in bpe.encode_rows(bpe.Encoder(bpe.vocabulary(PATH), None), data, np.array([0, len(data)])) for i in ids.tolist()]
    assert got == reference().encode(text, add_special_tokens=False).ids


def test_automaton_is_minimal_and_exact(tmp_path):
    """The compiled automaton holds just its words, each with its ids, in as few states as there are distinct sets of suffixes."""
    r = random.Random(1)
    some = sorted({" " * r.randint(0, 1) + "".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(300)})
    held = [w.encode() for w in some[::2]]
    n = bpe.compile_lexicon(held, bpe.vocabulary(PATH), str(tmp_path / "lex"))
    rights = {frozenset(w[k:] for w in held if w.startswith(p)) for w in held for k in range(len(w) + 1) for p in [w[:k]]}
    assert n == len(rights)
    lexicon = bpe.Lexicon(str(tmp_path / "lex"))
    raw = [w.encode() for w in some] + [b"zzz", b"ab" * 40]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    rank = lexicon.find(data, np.concatenate([[0], ends[:-1]]), ends)
    t = reference()
    for w, k in zip(raw, rank, strict=True):
        assert (k >= 0) == (w in held)
        if k >= 0:
            assert sorted(held)[k] == w
            assert lexicon.ids[lexicon.offset[k] : lexicon.offset[k + 1]].tolist() == t.encode(w.decode(), add_special_tokens=False).ids


def test_heap_merges_equal_the_arrays():
    v = bpe.vocabulary(PATH)
    for w in (b"hello", b" internationalization", b"x" * 300, bytes(range(48, 122))):
        data = np.frombuffer(w, np.uint8)
        ids, _ = v.merge(data, np.array([0]), np.array([len(w)]))
        assert ids.tolist() == v.merge_one(w)


def test_words_are_told_apart():
    data = np.frombuffer(b"aaaaaaaa1aaaaaaaa2aaaaaaaa1", np.uint8)
    head, name = words.distinct(data, np.array([0, 9, 18]), np.array([9, 18, 27]))
    assert len(head) == 2 and name[0] == name[2] != name[1]
