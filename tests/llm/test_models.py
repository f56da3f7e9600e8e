"""Parts of the corpus operators without Spark: codecs, hashes, scans, networks."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import ans, bpe_count, decontam, langid, line_dedup, simhash, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXT = st.text(alphabet=st.sampled_from(list("ab  \n\t'sdlv1²٣éßÜ漢😀́\x1c\x85\xa0-_.,<|endoftext|>İΣ")), max_size=60)


# ---------------------------------------------------------------- token counts and files


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return bpe_count.Counter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_counts_equal_the_library(counter, byte_library, texts):
    assert counter.count(texts) == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "  two  blanks ", "x<|endoftext|>y", "<|endoftext|>" * 3, "word " * 2000, "\n\n a\n b", "don't we'll I'VE"])
def test_counts_of_hard_texts(counter, byte_library, text):
    assert counter.count([text]) == [len(byte_library.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    own = ans.encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, per = own.encode(texts)
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_the_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(ans, "MEMORY", 50)
    own = ans.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcde", k=4)) + rng.choice(["", ".", ","]) for _ in range(40))
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_special_tokens=False).ids
    assert len(own.number) < 400


@pytest.mark.parametrize("n", [0, 1, ans.LANES, ans.BLOCK - 1, ans.BLOCK, ans.BLOCK + 1, 3 * ans.BLOCK + 17])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint16)
    count = np.bincount(ids, minlength=1 << 16)
    count[2] += 1
    freq = ans.quantise(count)
    assert freq.sum() == 1 << ans.SCALE and ((freq > 0) == (count > 0)).all()
    table = ans.Table(freq)
    blocks = ans.encode_blocks(ids, table)
    assert (ans.decode_blocks(blocks, n, table) == ids).all()


def test_coder_of_one_symbol_and_size():
    freq = ans.quantise(np.bincount([7] * 100, minlength=1 << 16))
    table = ans.Table(freq)
    ids = np.full(ans.BLOCK * 2, 7, np.uint16)
    assert (ans.decode_blocks(ans.encode_blocks(ids, table), len(ids), table) == 7).all()
    skewed = np.random.default_rng(0).choice(4, ans.BLOCK * 8, p=[0.7, 0.2, 0.07, 0.03])
    table = ans.Table(ans.quantise(np.bincount(skewed, minlength=1 << 16)))
    entropy = -sum(p * np.log2(p) for p in [0.7, 0.2, 0.07, 0.03]) * len(skewed) / 8
    assert sum(map(len, ans.encode_blocks(skewed, table))) < 1.5 * entropy + 8 * 5000


def test_damage_is_seen():
    table = ans.Table(ans.quantise(np.bincount([1, 2, 3], minlength=1 << 16)))
    image = bytearray(ans.file_image([None, 5], np.array([2, 1]), np.array([1, 2, 3], np.uint16), table))
    ids, per, got = ans.open_image(bytes(image), table)
    assert ids == [None, 5] and per.tolist() == [2, 1] and got.tolist() == [1, 2, 3]
    image[-3] ^= 1
    with pytest.raises(ValueError):
        ans.open_image(bytes(image), table)


# ---------------------------------------------------------------- line hashes


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.uint64)
    h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys).dump())
    assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_index_drops_all_but_the_keeper():
    h1, h2 = np.array([1, 2, 3], np.uint64), np.array([9, 8, 7], np.uint64)
    ix = line_dedup.Index.load(line_dedup.Index.build(h1, h2, np.array([5, 4, 900]), np.array([50, 40, 30]), 5).dump())
    probe = np.array([1, 1, 2, 3, 3, 99], np.uint64)
    tags = np.array([9, 9, 8, 7, 7, 1], np.uint64)
    gone = ix.drop(probe, tags, np.array([50, 2, 1, 30, -(2**63), 5]), 5)
    assert gone.tolist()[:5] == [False, True, False, False, True]


def test_line_keys():
    assert line_dedup.key_of(b" \t\x0b Ab\xc3\x89 \r") == b"ab\xc3\x89"


# ---------------------------------------------------------------- SimHash


def slow_print(text, width):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB É\n\x1c x", max_size=40))
def test_fingerprints(text):
    for width in (3, 5):
        assert simhash.fingerprint(text.encode(), width) == slow_print(text, width)


def test_block_masks_meet_all_close_pairs():
    masks = simhash.block_masks(3)
    rng = random.Random(0)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_forest_spans():
    fp = np.array([0, 1, 3, 0xFF00, 0xFF01], np.uint64)
    i, j = simhash.forest(fp, fp, True, 1)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (1, 2), (3, 4)]


# ---------------------------------------------------------------- language and toxicity


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(3, hidden=3)
    x, y = rng.integers(97, 105, (7, 5)), np.array([0, 1, 2, 0, 1])
    mask = (rng.random((7, 5)) < 0.8).astype(np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grads = net.gradients(x, y, mask)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        for at in rng.choice(np.flatnonzero(np.abs(grads[name].reshape(-1)) > 1e-4), 3) if (np.abs(grads[name]) > 1e-4).any() else []:
            old, losses = flat[at], []
            for step in (1e-2, -1e-2):
                flat[at] = old + step
                losses.append(net.gradients(x, y, mask)[0])
            flat[at] = old
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grads[name].reshape(-1)[at], rel=0.08, abs=2e-4)


def test_language_model_learns_and_batches_agree():
    rng = random.Random(3)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["schwarz", "weiß", "über"], "z": ["niño", "ciudad", "año"]}
    make = lambda k: " ".join(rng.choices(words[k], k=rng.randint(5, 60)))
    langs = [k for k in words for _ in range(40)]
    model = langid.train([make(k).encode() for k in langs], langs, steps=60)
    texts = [make(k).encode() for k in langs] + [b""]
    p = model.documents(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    assert np.mean([model.labels[i] == k for i, k in zip(p[:-1].argmax(axis=1), langs, strict=True)]) > 0.97
    assert p[-1].sum() == 0 and np.allclose(p[:-1].sum(axis=1), 1, atol=1e-4)
    alone = model.documents(np.frombuffer(texts[3], np.uint8), np.array([len(texts[3])]))
    assert np.allclose(alone[0], p[3], atol=1e-3)
    assert langid.train([], []) is None


def slow_segments(scores):
    """All maximal scoring segments by their definition: the best one, then those to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) < 1e-9 and j - i < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    left, right = slow_segments(scores[: best[0]]), slow_segments(scores[best[1] + 1 :])
    return left + [best] + [(a + best[1] + 1, b + best[1] + 1, s) for a, b, s in right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1.37, 2.11, 0.23]), max_size=24))
def test_segments_are_the_maximal_ones(gains):
    places = [k for k, g in enumerate(gains) if g]
    got = toxicity.segments(places, [gains[k] for k in places], -0.71)
    want = slow_segments([g if g else -0.71 for g in gains])
    assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_toxicity_learns_words_and_stems():
    rng = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna"]
    make = lambda y: " ".join(rng.choices(plain, k=40) + (["scum", "verta" + rng.choice("abcdefgh")] * 2 if y else [])).encode()
    ys = [k % 4 == 0 for k in range(200)]
    model = toxicity.train([make(y) for y in ys], [int(y) for y in ys])
    score = lambda t: model.score(model.passages(t)[1])
    assert score(make(1)) > 0.5 > score(make(0)) and score(b"vertazz " * 3) > 0.5 and 0 <= score(b"") < 0.5 and score(None) < 0.5
    assert toxicity.train([b"a"], [0]).score([]) < 0.01


# ---------------------------------------------------------------- alignment


def slow_align(a, b):
    best, old = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(max(0, old[k] + (decontam.MATCH if x == y else decontam.MISMATCH), old[k + 1] + decontam.GAP, new[k] + decontam.GAP))
        best, old = max(best, *new), new
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=15), st.lists(st.lists(st.integers(-1, 4), min_size=1, max_size=20), min_size=1, max_size=3))
def test_alignment(item, passages):
    got = decontam.align(np.array(item), [np.array(p) for p in passages])
    assert got.tolist() == [slow_align(item, p) for p in passages]


# ---------------------------------------------------------------- suffixes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=8, max_size=8), max_size=12), min_size=1, max_size=7))
def test_merge_of_runs(parts):
    runs = []
    for p in parts:
        strings = sorted(s.encode() for s in p)
        rows = np.array([list(s) for s in strings], np.uint8).reshape(len(strings), 8)
        common, rest = suffix_dedup.front_code(rows) if len(rows) else (np.zeros(0, np.uint8), b"")
        if len(rows):
            assert (suffix_dedup.front_decode(common, rest, 8) == rows).all()
        runs.append((strings, common.tolist()))
    order, common = suffix_dedup.merge(runs)
    place, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][0][place[r]])
        place[r] += 1
    assert out == sorted(s for r in runs for s in r[0])
    for k in range(1, len(out)):
        shared = next((i for i in range(8) if out[k][i] != out[k - 1][i]), 8)
        assert common[k] == shared


def test_anchors_follow_content():
    rng = np.random.default_rng(2)
    part = rng.integers(97, 100, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 37).astype(np.uint8), part]), np.concatenate([part, rng.integers(97, 123, 90).astype(np.uint8)])]
    found = []
    for t, shift in ((texts[0], 37), (texts[1], 0)):
        at = suffix_dedup.anchors(t, np.array([len(t)])) - shift
        found.append({int(x) for x in at if suffix_dedup.SIDE <= x <= 400 - suffix_dedup.LENGTH})
        every = suffix_dedup.anchors(t, np.array([len(t)]))
        assert all(((every >= s) & (every <= s + suffix_dedup.SIDE)).any() for s in range(len(t) - suffix_dedup.LENGTH + 1))
    assert found[0] == found[1] and found[0]
    both = np.concatenate(texts)
    joint = suffix_dedup.anchors(both, np.array([len(t) for t in texts])).tolist()
    assert joint == suffix_dedup.anchors(texts[0], np.array([len(texts[0])])).tolist() + (suffix_dedup.anchors(texts[1], np.array([len(texts[1])])) + len(texts[0])).tolist()


def slow_removal(docs):
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], d)
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            f = first[raw[p : p + 50]]
            if f != d and (d is None or f < d):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out
