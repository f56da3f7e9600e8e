"""The corpus operators on small tables, against brute force; nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import ans, bpe_count, decontam, embed_dedup, langid, line_dedup, mixing, queries, simhash, suffix_dedup, toxicity

from .test_models import slow_print, slow_removal

public_tokenizers = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row string, fp long, key string, class string, tiles int, start long, target double"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "v", "nd", "x") for c in ("a", "en", "ió", "um")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def table(spark, rows, extra=True):
    """Rows (doc_id, text, source) as documents, with columns whose names the operators use themselves."""
    full = [(d, t, "en" if (d or 0) % 2 else None, s, len(t or ""), -1, -1.0, "r", 7, "k", "c", 3, -5, 0.5) for d, t, s in rows]
    return spark.createDataFrame(full, SHAPE).repartition(4)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared lines and passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(7)
    passage, line = prose(rng, 30), "  " + prose(rng, 12).upper() + "\t"
    rows = []
    for d in range(60):
        text = prose(rng, rng.randint(1, 90))
        if d % 7 == 0:
            text = text + "\n" + line + "\n" + prose(rng, 5)
        if d % 11 == 3:
            text = passage + " " + text
        rows.append((d * 3, text, rng.choice(["a", "b", "ü", None])))
    base = prose(rng, 300)
    rows += [(1000 + k, base, "a") for k in range(6)]
    rows += [(1100 + k, base[:-k] if k else base + " x", "b") for k in range(4)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, " \n\t ", "b"), (None, base, "a"), (None, None, None), (2003, prose(rng, 9000), "c"), (2004, "§§ 123 !!", "c")]
    rows += [rows[5], rows[5], rows[61]]
    return rows


# ---------------------------------------------------------------- mixing


def test_mix_targets_are_the_water_level(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500), ("d", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 1, "d": 0, None: 500}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    clamped, free = {}, dict(size)
    while True:
        left = sum(size.values()) - sum(clamped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        clamped |= {s: 3 * size[s] for s in over}
        free = {s: v for s, v in free.items() if s not in over}
    want = clamped | share
    assert {s: pytest.approx(v) for s, v in want.items()} == got


def test_mix_takes_near_the_target(spark, corpus):
    df = table(spark, corpus)
    rows = mixing.op2_query(df).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.op2_query(df.repartition(9)).collect()), key=str)
    assert len(rows) == len(corpus) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    assert mixing.op2_query(table(spark, []).limit(0)).count() == 0
    staged = mixing.stage(df)
    assert staged.where("size <> -1 OR target <> 0.5").count() == 0
    assert staged.columns == df.columns and staged.count() == sum(r["taken"] // r["size"] for r in rows if r["size"]) + staged.where("size(regexp_extract_all(coalesce(text,''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) = 0").count()


# ---------------------------------------------------------------- lines


def slow_lines(rows):
    held = {}
    for k, (d, t, _) in enumerate(rows):
        for line in (t or "").split("\n"):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40:
                held.setdefault(key, {})[k] = -1 if d is None else d
    out = []
    for d, t, _ in rows:
        kept, dropped = [], 0
        for line in (t or "").split("\n"):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(held.get(key, ())) >= 5 and max(held[key].values()) != d:
                dropped += 1
            else:
                kept.append(line)
        out.append((d, len(kept) + dropped, dropped, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark, corpus):
    got = sorted((tuple(r) for r in line_dedup.op3_query(table(spark, corpus)).collect()), key=str)
    assert got == slow_lines(corpus) and any(r[2] for r in got)
    assert line_dedup.op3_query(table(spark, []).limit(0)).count() == 0


def test_a_line_that_most_documents_hold(spark):
    rows = [(d, "x" * 45 + "\nown line of the document number %d, long enough" % d, "a") for d in range(900)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op3_query(table(spark, rows)).collect()}
    assert got == {d: int(d != 899) for d in range(900)}


def test_repeated_rows_count_each(spark):
    line, other, four = "a line of forty characters or more, number one", "another line of forty characters or more, two", "a line that only four rows hold, forty or more"
    rows = [(None, line + "\n" + line, "a")] * 5 + [(7, other, "a")] * 4 + [(6, other, "a")] + [(None, four + "\n" + four, "a")] * 4
    got = sorted((tuple(r) for r in line_dedup.op3_query(table(spark, rows)).collect()), key=str)
    assert got == slow_lines(rows) and sum(r[2] for r in got) == 11


# ---------------------------------------------------------------- SimHash


def slow_groups(prints, close):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if close(prints[i], prints[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash(spark, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op10_query(table(spark, corpus)).collect()), key=str)
    prints = [slow_print(t, 3) for _, t, _ in corpus]
    group = slow_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (d, _, _), g in zip(corpus, group, strict=True):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    assert got == sorted(((d, f"{p:016x}", low.get(g)) for (d, _, _), p, g in zip(corpus, prints, group, strict=True)), key=str)


def test_simhash_tiles_of_a_crowded_block(spark):
    rng = random.Random(2)
    center = rng.getrandbits(63)
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 2))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)})
    df = spark.createDataFrame([(p, p) for p in prints], "fp long, id long")
    group = slow_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for tile in (7, 1024):
        edges = [(r["u"], r["v"]) for r in simhash.links(df, 3, tile).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        linked = {frozenset(e) for e in edges}
        again = slow_groups(prints, lambda a, b: frozenset((a, b)) in linked)
        assert again == group


def test_near_texts_have_the_similarity(spark):
    rng = random.Random(8)
    texts, group = [], []
    for g in range(40):
        base = rng.choices(WORDS, k=rng.randint(60, 400))
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(len(words) // 100):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
            group.append(g)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(df, tile=3).collect()}
    for a in range(len(texts)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.85:
                assert got[a] == got[b]
            if group[a] != group[b]:
                assert got[a] != got[b]


def edited_pair(rng, similarity, n=400):
    """Two texts of which a run of words differs, so that their sets have about the similarity, or a little more."""
    cut = int(n * (1 - similarity) / (1 + similarity)) - 4
    base = [rng.choice(WORDS) + str(rng.randrange(10**4)) for _ in range(n)]
    at = rng.randrange(5, n - cut - 5)
    return base, base[:at] + ["edit%d" % rng.randrange(10**9) for _ in range(cut)] + base[at + cut :]


@pytest.mark.parametrize("n", [50_000, 2_500_000, 15_000_000])
def test_keys_find_pairs_at_the_similarity(n):
    rng = random.Random(n)
    samples, most = simhash.plan_keys(n, 0.8)
    assert simhash.missed(0.8, samples.shape[1], len(samples), most) <= simhash.MISS
    for similarity in (0.8, 0.85):
        hits = 0
        for _ in range(400):
            a, b = ([np.unpackbits(np.frombuffer(simhash.wide_fingerprint(" ".join(w).encode()), np.uint8)) for w in edited_pair(rng, similarity)])
            differ = a != b
            hits += differ.sum() <= most and not differ[samples].any(axis=1).all()
        print(n, similarity, samples.shape[::-1], most, hits / 400)
        assert hits / 400 >= 0.97


def test_links_are_verified(spark):
    """A line repeated in two texts of their own brings fingerprints over all shingles close, and pairs at 0.65 are within the cut."""
    rng = random.Random(12)
    rows = []
    for g in range(20):
        line = rng.choices(WORDS, k=14)
        rows += [(g * 10 + k, " ".join(rng.choices(WORDS, k=150) + line * 30)) for k in range(2)]
        base = rng.choices(WORDS, k=400)
        rows += [(g * 10 + 5, " ".join(base)), (g * 10 + 6, " ".join(base[:322] + rng.choices(WORDS, k=78)))]
    for tile in (1, 512):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
        assert got == {d: d for d, _ in rows}


def test_a_failed_edge_hides_no_link(spark, monkeypatch):
    """Big groups whose forest has edges that aren't links: the components are those of all pairs at the similarity."""
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        base = rng.choices(WORDS, k=300)
        for _ in range(30):
            words = list(base)
            cut = rng.choice((15, 30, 45))
            at = rng.randrange(300 - cut)
            words[at : at + cut] = ["edit%d" % rng.randrange(10**6) for _ in range(cut)]
            texts.append(" ".join(words))
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    group = slow_groups(sets, lambda a, b: simhash.similar(a, b) >= 0.8)
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "plan_keys", lambda n, similarity: (np.array([[0]]), 256))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(list(enumerate(t for t in texts)), "doc_id long, text string")).collect()}
    pairs = {(a, b) for b in range(90) for a in range(b) if simhash.similar(sets[a], sets[b]) >= 0.8}
    reach = {(a, b) for a, b in pairs if (wide_bits(texts[a]) ^ wide_bits(texts[b])) & (1 << 7) == 0}
    linked = slow_groups(list(range(90)), lambda a, b: (b, a) in reach)
    assert len(set(linked)) < 90 and len(set(group)) > 3
    assert all((got[a] == got[b]) == (linked[a] == linked[b]) for b in range(90) for a in range(b))


def wide_bits(text):
    return int.from_bytes(simhash.wide_fingerprint(text.encode()), "little")


def test_simhash_stage_keeps_one_of_each_group(spark, corpus):
    df = table(spark, corpus)
    out = simhash.stage(df)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert out.columns == df.columns and len(ids) - ids.count(None) == len(set(ids) - {None})
    assert ids.count(None) == 2 and 1000 in ids and not {1001, 1002, 1003} & set(ids)


def test_stages_tell_rows_apart_by_their_text(spark):
    rng = random.Random(31)
    a, b, item = prose(rng, 200), prose(rng, 200), prose(rng, 40)
    rows = [(1, a), (1, b), (2, b), (None, a), (None, a), (None, item + " x"), (3, prose(rng, 50) + " " + item), (3, prose(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in simhash.stage(docs).collect()]
    assert sorted(out, key=str) == sorted({*rows} - {(2, b)}, key=str)
    kept = [tuple(r) for r in decontam.stage(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([*rows[:5], rows[7]], key=str)


# ---------------------------------------------------------------- suffixes


def test_suffixes(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    got = [tuple(r) for r in suffix_dedup.op6_query(table(spark, corpus)).collect()]
    want = slow_removal([(d, t) for d, t, _ in corpus if d is not None])
    named = [r for r in got if r[0] is not None]
    assert len(named) == sum(d is not None for d, _, _ in corpus)
    assert all((r[1:]) == want[r[0]] for r in named) and sum(r[2] for r in named) > 1000
    assert any(r[2] == r[1] > 0 for r in got if r[0] is None)  # a copy without an id goes
    assert suffix_dedup.op6_query(table(spark, []).limit(0)).count() == 0


def test_suffixes_of_periodic_and_random_bytes(spark):
    rng = random.Random(4)
    texts = ["a" * 200, "a" * 49, "a" * 50, "ab" * 60, "ba" * 60, "".join(rng.choices("ab", k=3000))]
    texts += [texts[-1][500:1200] + "é" * 40 + texts[-1][:300], "é" * 60, "x" + "é" * 60, "\0" * 80, "\0" * 55 + "q"]
    rows = [(k * 5 + 1, t, "a") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.op6_query(table(spark, rows)).collect()}
    assert got == slow_removal([(d, t) for d, t, _ in rows])


# ---------------------------------------------------------------- embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(k, base[k].tolist()) for k in range(30)]
    rows += [(100 + k, (base[0] + rng.normal(size=16) * 0.12).tolist()) for k in range(60)]
    rows += [(200 + k, (base[1] * (k + 1)).tolist()) for k in range(4)] + [(300 + k, base[2].tolist()) for k in range(5)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, []), (404, [None] + [1.0] * 15), (405, [float("inf")] * 16), (406, [1.0, 2.0])]
    rows += [(3, base[3].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, class string")
    old = embed_dedup.TILE
    try:
        for tile in (5, 512):
            embed_dedup.TILE = tile
            got = sorted(tuple(r) for r in embed_dedup.op9_query(df).collect())
            sound = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
            unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in sound}
            n, parent = [0] * len(rows), list(range(len(rows)))
            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i
            for a in sound:
                for b in sound:
                    if a < b and unit[a] @ unit[b] >= 0.95:
                        n[a] += 1
                        n[b] += 1
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
            low = {}
            for k, (i, _) in enumerate(rows):
                low[root(k)] = min(i, low.get(root(k), i))
            want = sorted((i, n[k], low[root(k)], i == low[root(k)]) for k, (i, _) in enumerate(rows))
            links, found = sum(w[1] for w in want), sum(g[1] for g in got)
            assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.9 * links
            assert [g[2:] for g in got] == [w[2:] for w in want]
    finally:
        embed_dedup.TILE = old
    assert embed_dedup.op9_query(df.limit(0)).count() == 0


def test_tables_follow_the_number_of_vectors():
    assert embed_dedup.plan_tables(1000)[0] < embed_dedup.plan_tables(10**8)[0]
    for n in (100, 10**6):
        k, tables = embed_dedup.plan_tables(n)
        assert (1 - embed_dedup.collision((2 - 2 * 0.95) ** 0.5) ** k) ** tables <= embed_dedup.MISS


# ---------------------------------------------------------------- tokens


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in bpe_count.op7_query(table(spark, corpus)).collect()), key=str)
    want = []
    for d, t, _ in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)


def test_token_files(spark, corpus, monkeypatch):
    monkeypatch.setattr(ans, "SHARD", 700)
    rows = [r for r in corpus if corpus.count(r) == 1 and r[0] is not None]
    own = ans.encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in ans.op8_query(table(spark, rows)).collect()}
    start, want = 0, {}
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = own.library.encode(t or "", add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    whole = ans.op8_query(table(spark, corpus)).collect()
    assert len(whole) == len(corpus) and {r["start"] for r in whole if r["doc_id"] is None} <= {0, *[r["n_tokens"] for r in whole if r["doc_id"] is None]}
    assert ans.op8_query(table(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- language, toxicity, decontamination


def test_language(spark):
    rng = random.Random(1)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["schwarz", "weiß", "über"]}
    rows = [(d, " ".join(rng.choices(words["xy"[d % 2]], k=rng.randint(3, 50))), "xy"[d % 2]) for d in range(160)] + [(500, None, "x"), (501, "", "y"), (502, "12 ++", None), (None, "alpha beta gamma " * 12, None), (503, "schwarz über " * 8000, None)]
    df = spark.createDataFrame([(d, t, k, "s", 0.1, "z") for d, t, k in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3)
    got = {r["doc_id"]: r for r in langid.op1_query(df).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2) for d, r in got.items())
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (500, 501, 502)) and got[503]["lang_pred"] == "y" and got[None]["lang_pred"] == "x"
    assert np.mean([got[d]["lang_pred"] == k for d, _, k in rows[:160]]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.op1_query(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.stage(df)
    assert kept.columns == df.columns and not {500, 501, 502} & {r["doc_id"] for r in kept.collect()}
    assert kept.where("score <> 0.1 OR lang_pred <> 'z'").count() == 0 and kept.count() == len(rows) - 3
    assert langid.op1_query(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for d in range(200):
        bad = d % 5 == 1
        rows.append((d, prose(rng, 40) + (" you scum " + prose(rng, 3) + " scum" if bad else "")))
        marks.append((d, int(bad)))
    rows += [(900, None), (901, ""), (None, "scum scum"), (902, prose(rng, 5000)), rows[1]]
    docs = spark.createDataFrame([(d, t, 1, 0.5) for d, t in rows], "doc_id long, text string, toxic int, score double").repartition(3)
    labels = spark.createDataFrame([*marks, (900, 1), (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.op4_query(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[d]["predicted"] == y for d, y in marks]) > 0.97 and by[None]["predicted"] == 1 and by[902]["predicted"] == 0 and by[901]["predicted"] == 0
    spans = {r["doc_id"]: r["passages"] for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), ["doc_id"]).collect()}
    assert all(p["first"] <= p["last"] and 0 < p["p"] <= 1 for p in spans[1]) and spans[1] and not spans[900]
    assert {r["predicted"] for r in toxicity.op4_query(docs, labels.limit(0)).collect()} == {0}


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs" for d in ("t", "k", "nd")]
    make = lambda n: rng.choices(words, k=n)
    items = [(k, make(rng.randint(14, 30))) for k in range(12)]
    edited = list(items[3][1])
    edited[6] = "other"
    del edited[10]
    rows = [(k, " ".join(make(120))) for k in range(50)]
    rows += [(100, " ".join(make(60) + items[2][1] + make(60))), (101, " ".join(make(10) + edited + make(400))), (102, "; ".join(w.upper() for w in items[5][1])), (103, " ".join(items[1][1][:4])), (104, None), (105, ""), (None, " ".join(items[7][1]))]
    rows += [(200 + k, " ".join(make(20) + items[4][1])) for k in range(150)] + [rows[50]]
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id long, text string, item_id int, score double").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(50, None, "y"), (51, " .. ", "z"), (52, " ".join(items[2][1]), "same")], "item_id long, text string, extra string")
    want = {(100, 2), (100, 52), (101, 3), (102, 5), (None, 7)} | {(200 + k, 4) for k in range(150)}
    for block in (decontam.BLOCK_SEEDS, 60):
        monkeypatch.setattr(decontam, "BLOCK_SEEDS", block)
        assert {(r["doc_id"], r["item_id"]) for r in decontam.op5_query(docs, bench).collect()} == want
    kept = decontam.stage(docs, bench)
    assert kept.columns == docs.columns and not {100, 101, 102, 200} & {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 103").count() == 1
    assert decontam.op5_query(docs, bench.limit(0)).count() == 0 and decontam.op5_query(docs.limit(0), bench).count() == 0


def test_decontamination_of_partial_passages(spark):
    """Verbatim and slightly edited parts of long items count, whatever share of the item they are; scattered words don't."""
    rng = random.Random(21)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs" for d in ("t", "k", "nd")]
    make = lambda n: rng.choices(words, k=n)
    common = ["the", "of", "and", "to"]
    items = [make(59), make(250), make(120), rng.choices(common, k=60) + make(40)]
    edited = items[2][40:75]
    edited[10] = "other"
    del edited[25]
    scattered = [w for k in range(0, 120, 8) for w in (*items[2][k : k + 4], *make(6))]
    rows = [(1, make(80) + items[0][10:39] + make(80)), (2, make(50) + items[1][100:200] + make(9)), (3, items[1][3:16] + make(40)), (4, make(30) + edited + make(30)), (5, make(30) + scattered), (6, items[1][3:15] + make(60))]
    rows += [(7, make(30) + items[3][20:40] + make(30))] + [(100 + k, [w for x in make(60) for w in (x, rng.choice(common))]) for k in range(50)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.op5_query(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 1), (4, 2), (7, 3)} and max(got.values()) < 0.5
    assert {r["doc_id"] for r in decontam.stage(docs, bench).collect()} == {5, 6} | {100 + k for k in range(50)}


# ---------------------------------------------------------------- registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, base).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(tuple, df.astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline as p

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    first = p.language(spark, docs, base)
    assert first.columns == docs.columns and first.count() > 0.9 * docs.count()
    rows = p.run(spark, base).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert rows and max(r["start"] + r["n_tokens"] for r in rows) == total and len({r["start"] for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
