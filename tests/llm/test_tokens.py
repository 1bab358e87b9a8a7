import hashlib
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as vocabularies
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridia.llm import bpe, chat, packing

BYTES, WORDS = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("word_bpe_49k.json")
STRINGS = [
    "", "a", "aaaaaaaa aaaa", "  lead", "x   y\n\n z \n", "it's we'll 'sx  's", "　\x85 x\xa0y\x1cz \x1f", "<|endoftext|> a <|endoftext|>", "é é ẖ H̱ ẞ İ ΣΑΣ K Å ﬁ", "日本語 текст 123 45 ٣٤ ½²",
    "👍🏽 👨‍👩‍👧", "a​b﻿c", "\x00\x01", "<|startoftext|>Hi<|endoftext|>", "tab\tsep\r\n", "don't DON'T", " \n", " ", "\n \n  a", ":\U0003d000", "a\u0558b 1\U0001246f", "\u1c89x \ua7cb",
]
any_text = st.text(max_size=60) | st.text(st.sampled_from("aAbB 's\n\t!é日́ "), max_size=40)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(any_text)
def test_bpe_is_the_librarys(byte_library, text):
    codec = bpe.codec(BYTES)
    want = byte_library.encode(text, add_special_tokens=False).ids
    assert codec.encode_ids(text) == want
    assert codec.decode(want) == byte_library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", STRINGS)
def test_bpe_of_odd_strings(byte_library, text):
    assert bpe.codec(BYTES).encode_ids(text) == byte_library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(any_text)
def test_words_are_the_librarys(word_library, text):
    got = np.frombuffer(packing.vocabulary(WORDS).ids([text])[0], "<u4").tolist()
    assert got == word_library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", STRINGS)
def test_words_of_odd_strings(word_library, text):
    assert np.frombuffer(packing.vocabulary(WORDS).ids([text])[0], "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_workers_forget(monkeypatch):
    codec = bpe.Codec(BYTES)
    monkeypatch.setattr(bpe, "KNOWN_STRETCHES", 2)
    first = [codec.encode([t]) for t in ("a b c d", "a b c d")]
    assert first[0] == first[1] and len(codec.known) <= 4


def test_bpe_digests(odd, documents, no_documents, byte_library):
    for docs in (odd, documents):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
        want = []
        for i, t in texts:
            ids = byte_library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digests(docs, BYTES).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(no_documents, BYTES).count() == 0
    back = bpe.decode(bpe.encode(odd, BYTES), BYTES)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=str)


def check_packing(docs, library, capacity):
    rows = packing.pack(docs, WORDS, capacity).collect()
    want, got = [], []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            own = ids[at : at + capacity]
            want.append((r.doc_id, at // capacity, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    sequences = {}
    for r in rows:
        got.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got, key=str) == sorted(want, key=str)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(odd, documents, no_documents, word_library, capacity):
    for docs in (odd, documents):
        used, total = check_packing(docs, word_library, capacity)
        assert used <= -(-total // capacity) * 11 / 9 + 1
    assert packing.pack(no_documents, WORDS, capacity).count() == 0


def fewest(sizes, capacity):
    """The fewest sequences, by trying every way to fill one with the longest piece."""
    sizes = sorted(sizes, reverse=True)
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for n in range(len(rest) + 1):
        for beside in set(combinations(range(len(rest)), n)):
            if first + sum(rest[i] for i in beside) <= capacity:
                best = min(best, 1 + fewest([s for i, s in enumerate(rest) if i not in beside], capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7))
def test_reduction_keeps_an_optimum(sizes):
    """What the reduction fixes, with the best packing of the rest, is a best packing."""
    capacity = 12
    counts = {s: sizes.count(s) for s in sizes}
    groups, fixed = packing.reduce_and_pack(counts, capacity)
    assert sorted(s for n, own in groups for s, k in own.items() for _ in range(n * k)) == sorted(sizes)
    assert all(sum(s * k for s, k in own.items()) <= capacity for _, own in groups)
    rest, left = sorted(sizes), fixed
    for n, own in groups:
        for _ in range(min(n, left)):
            for s, k in own.items():
                for _ in range(k):
                    rest.remove(s)
        left -= min(n, left)
    assert fixed + fewest(rest, capacity) == fewest(sizes, capacity)


CHAT = (vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
SCHEMA = "conv_id long, turn long, role string, text string, ids string, start int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", " ", "x", "</", "turn>"]), max_size=8).map("".join) | st.text(max_size=20))
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    own = chat.template(*CHAT)
    ids, _, _ = own.segment("user", text)
    assert [i for i in ids if i in own.marks] == [own.turn, own.content, own.end]
    role, said = own.read(np.array(ids))
    assert (role, chat.unescape(said)) == ("user", text)


def test_chat_formatting_agrees_with_sql(agree):
    agree(chat.op2_chat_formatting, chat.ORACLE)


def test_chat_digests(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a <|end|> b"), (1, 2, "assistant", None), (1, 3, "assistant", "é👍"), (2, 1, "assistant", "later"), (2, 0, None, "first"),
        (2, None, "system", "null turn first"), (None, 0, "assistant", "no id"), (3, 0, "user", "x" * 50_000), (3, 0, "user", "x" * 50_000), (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE),
    ]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA), *CHAT).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        turns = sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0))
        loss = "".join(d[3] or "" for d in turns if d[2] == "assistant")
        said = "".join(f"{d[2] or ''}\n{d[3] or ''}\n" for d in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        rendered = "".join(f"<|turn|>{chat.escape(d[2] or '')}<|content|>{chat.escape(d[3] or '')}<|end|>" for d in turns)
        assert r.formatted_chars == len(rendered)
    assert chat.digests(spark.createDataFrame([], SCHEMA), *CHAT).count() == 0


def test_offsets_are_prefix_sums(spark):
    data = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(6)]
    rows = sorted(chat.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), *CHAT).collect(), key=lambda r: r.position)
    at = 0
    for i, r in enumerate(rows):
        assert (r.position, r.start, len(r.loss_mask)) == (i, at, len(r.ids))
        assert any(r.loss_mask) == bool(i % 2)
        at += len(r.ids)
