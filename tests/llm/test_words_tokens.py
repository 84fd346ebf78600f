"""Words, shingles and token ids against plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import simple8b
from quarry.llm.minhash import COORDINATES, sketch
from quarry.llm.packing import best_fit_decreasing
from quarry.llm.suffix import common_prefixes, merge_shards, suffix_array
from quarry.llm.tokens import TokenEncoder, tokenizer_path
from quarry.llm.words import WORD_BYTES, byte_runs, distinct_by_row, hashed_words, shingles, text_buffer

ODD = ["", None, "a  b\n\nc \n d\t\te", "don't can'T we're 'tis x''s !!a", "é  \n\nx　 y", "\n\nFoo\r\nBar  \n", " lead", "trail ", "<|endoftext|> hi<|startoftext|>", "é ́x ≠ a\x1c b\x00 c", "中文 字符。\n中", "ΑΣ ΣΑ\tΣ", "\u0085 x  y", "à B.c,D;e1 2 3.4 '5", "x\ńy  z", "it's’s ok", "x" * 3000 + " y"]
text = st.lists(st.sampled_from(["the", "The.", " ", "  ", "\n", "é", "ß", "don't", "x1", "!!", "\t", "中", " ", "'", "s", "\r\n", " "]), max_size=40).map("".join)


def words_of(x: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def test_words_and_shingles_are_those_of_the_definition():
    column = pa.array(ODD)
    for a, b, hashes, off in hashed_words(column):
        grams, goff = distinct_by_row(*shingles(hashes, off))
        for r in range(b - a):
            words = words_of(ODD[a + r])
            assert off[r + 1] - off[r] == len(words)
            sets = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            assert goff[r + 1] - goff[r] == len(sets)


def test_buffers_follow_slices_and_nulls():
    buf, off = text_buffer(pa.array(["ab", None, "c", "dé"]).slice(1, 3))
    assert bytes(buf) == "cdé".encode() and off.tolist() == [0, 0, 1, 4]
    starts, ends, _, rows = byte_runs(*text_buffer(pa.array(["a b", "c"])), WORD_BYTES)
    assert starts.tolist() == [0, 2, 3] and ends.tolist() == [1, 3, 4] and rows.tolist() == [0, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(text, min_size=1, max_size=8))
def test_piecewise_ids_equal_whole_text_ids(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        mine = ENCODERS.setdefault(name, TokenEncoder(tokenizer_path(name)))
        want = [x.ids for x in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids[x:y].tolist() for _, _, ids, off in mine.rows(pa.array(texts)) for x, y in zip(off[:-1], off[1:], strict=True)]
        assert got == want


ENCODERS: dict[str, TokenEncoder] = {}


def test_odd_texts_have_the_librarys_ids():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        mine = ENCODERS.setdefault(name, TokenEncoder(tokenizer_path(name)))
        want = [x.ids for x in mine.tokenizer.encode_batch([x or "" for x in ODD], add_special_tokens=False)]
        assert [ids[x:y].tolist() for _, _, ids, off in mine.rows(pa.array(ODD)) for x, y in zip(off[:-1], off[1:], strict=True)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=800))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words) == ids).all() and offsets[-1] == len(words)
    block = simple8b.block_bytes(np.array([5, 6]), np.array([True, False]), np.array([len(ids), 0]), ids)
    doc_ids, valid, counts, back = simple8b.read_block(block)
    assert doc_ids.tolist() == [5, 6] and valid.tolist() == [True, False] and counts.tolist() == [len(ids), 0] and (back == ids).all()
    if len(ids):
        first = len(ids) // 3
        assert (simple8b.read_ids(block, first, 250) == ids[first : first + 250]).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_packing_equals_placing_one_by_one(counts):
    import bisect

    open_windows: list[int] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            i = bisect.bisect_left(open_windows, size)
            bisect.insort(open_windows, (open_windows.pop(i) if i < len(open_windows) else 64) - size)
    fill: dict[int, list[tuple[int, int]]] = {}
    placed: dict[int, int] = {}
    for length, _, pieces, sequence, offset in best_fit_decreasing(counts, 64):
        placed[length] = placed.get(length, 0) + pieces
        for i in range(pieces):
            fill.setdefault(sequence + i, []).append((offset, length))
    assert placed == counts
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    assert sorted(64 - sum(n for _, n in p) for p in fill.values()) == sorted(open_windows)


def test_sketches_fill_and_estimate():
    random = np.random.default_rng(3)
    base = random.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [base, np.concatenate([base[:540], random.integers(0, 2**63, 60, dtype=np.uint64)]), base[:3], np.zeros(0, np.uint64), base[:1]]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = sketch(np.concatenate(sets), off)
    assert out.shape == (5, COORDINATES) and (out[:3] != np.uint64(2**64 - 1)).all() and (out[4] != np.uint64(2**64 - 1)).all()
    assert abs((out[0] == out[1]).mean() - 540 / 660) < 0.15
    assert (out[3] == 0).all()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200).map(lambda b: bytes(x % 3 for x in b)), st.integers(2, 20))
def test_suffix_arrays_and_prefixes(data, width):
    x = np.frombuffer(data, np.uint8)
    order = suffix_array(x)
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))
    for k, n in enumerate(common_prefixes(x, order, width)):
        a, b = (data[order[k] :], data[order[k - 1] :]) if k else (b"", b"")
        same = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert n == min(same, width)
    cut, owner = len(x) // 2, np.arange(len(x)) % 7
    shards = [(x[:cut], np.arange(cut) + width <= cut, owner[:cut]), (x[cut:], np.arange(len(x) - cut) + width <= len(x) - cut, owner[cut:])]
    best: dict[bytes, int] = {}
    for t, ok, own in shards:
        for i in np.flatnonzero(ok):
            key = t[i : i + width].tobytes()
            best[key] = min(best.get(key, 99), own[i])
    for (t, ok, _), least in zip(shards, merge_shards(shards, width), strict=True):
        assert all(least[i] == best[t[i : i + width].tobytes()] for i in np.flatnonzero(ok))


def test_crc_of_known_bytes():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\x00\x00\x00")


def test_added_tokens_in_texts_are_matched_as_by_the_plain_library_call():
    from tokenizers import Tokenizer

    texts = ["abc <|endoftext|> def", "", "abc def", "<|startoftext|>Foo  bar<|endoftext|>", "ABC <|EndOfText|> def", None, "<|endoftext|><|endoftext|>", "a <|endof", "text|> b", "  x <|endoftext|>\n\n y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain, mine = Tokenizer.from_file(tokenizer_path(name)), TokenEncoder(tokenizer_path(name))
        want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [ids[x:y].tolist() for _, _, ids, off in mine.rows(pa.array(texts)) for x, y in zip(off[:-1], off[1:], strict=True)] == want
    assert want[0] == [5334, 49407, 11649]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=7))
def test_kneser_ney_equals_plain_recursion(toxic, ordinary, word):
    """Class models against Kneser-Ney written down directly over tuples of symbols."""
    from collections import Counter

    from quarry.llm.kneser_ney import ORDER, SHARED, ClassModels, spelt

    def grams(words):
        out = []
        for w in words:
            symbols = [0] * (ORDER - 2) + [1, *w.encode(), 2]
            out += [tuple(symbols[i - ORDER + 1 : i + 1]) for i in range(ORDER - 1, len(symbols))]
        return out

    def keys_of(words):
        data = "".join(words).encode()
        ends = np.cumsum([len(w) for w in words])
        return spelt(np.frombuffer(data, np.uint8), ends - [len(w) for w in words], ends)[0]

    tables = [np.unique(keys_of(words), return_counts=True) for words in (ordinary, toxic)]
    models = ClassModels(tables)

    def level(counts):
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = min(0.95, max(0.5, once / (once + 2 * twice))) if once else 0.5
        totals, kinds = Counter(), Counter()
        for g, c in counts.items():
            totals[g[:-1]] += c
            kinds[g[:-1]] += 1
        return counts, d, totals, kinds

    def lower_of(counts):
        return Counter(g[1:] for g in counts)

    def mixed(found, gram, below):
        counts, d, totals, kinds = found
        head = gram[:-1]
        if head not in totals:
            return below
        return (max(counts.get(gram, 0) - d, 0) * (gram in counts) + d * kinds[head] * below) / totals[head]

    own, shared = [], {}
    pooled = dict.fromkeys([*grams(ordinary), *grams(toxic)], 1)
    for order in range(ORDER - 1, 0, -1):
        pooled = lower_of(pooled)
        if order <= SHARED:
            shared[order] = level(pooled)
    for words in (ordinary, toxic):
        counts, levels = Counter(grams(words)), {}
        levels[ORDER] = level(counts)
        for order in range(ORDER - 1, SHARED, -1):
            counts = lower_of(counts)
            levels[order] = level(counts)
        own.append(levels)

    want = []
    for gram in grams([word]):
        p = 1 / 256
        for order in range(1, SHARED + 1):
            p = mixed(shared[order], gram[-order:], p)
        logs = []
        for levels in own:
            q = p
            for order in range(SHARED + 1, ORDER + 1):
                q = mixed(levels[order], gram[-order:], q)
            logs.append(np.log(q))
        want.append(logs[1] - logs[0])
    assert np.allclose(models.ratio(keys_of([word])), want)
