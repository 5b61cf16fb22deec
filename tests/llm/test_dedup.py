"""Near-dedup and substring operators on edge cases, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from tessella.llm import embeddings, minhash
from tessella.llm.bwt import remove_repeats as remove_bytes
from tessella.llm.components import components
from tessella.llm.embeddings import linked_pairs, near_embeddings
from tessella.llm.minhash import drop_near_duplicates, linked_in_tile, near_duplicates, odd_sketch, samples
from tessella.llm.substring import remove_repeats as remove_words


def groups(nodes, linked):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)] + [(5, 5), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in links if a is not None and a != b} | {(b, a) for a, b in links if a is not None and a != b}
    nodes = sorted({a for a, _ in pairs})
    assert got == groups(nodes, lambda a, b: (a, b) in pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def family(rng, size, words, change):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(change):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


@pytest.mark.parametrize("small", [16, 2])
def test_minhash_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE_ROWS", 8)
    rng = random.Random(8)
    texts = [None, "", " \n", "a b", "A  b", "a b c d", "A B C\\tD"] + family(rng, 40, 120, 3) + family(rng, 12, 60, 1) + ["same words here again and again"] * 5 + [" ".join(f"t{k}" for k in range(30000))]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a b c d", 1)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r for r in near_duplicates(df, width=4).collect()}
    sets = {k: shingle_set(t, 4) for k, t in enumerate(texts)}
    want = groups(list(sets), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert len(got) == len(texts) + 1 and got[None]["kept"]
    for k in sets:
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(sets[k]), want[k], want[k] == k), texts[k]
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_stranger_in_a_large_bucket_adds_tiles_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE_ROWS", 16)
    dealt = {}
    for n in (400, 800):
        rows = [(5, d, 0, 10) for d in range(n)] + [(5, n + 1, 1, 10), (5, n + 2, 2, 10)] + [(6, d, d % 2 * 7, 10) for d in range(64)]
        got = minhash._dealt(spark.createDataFrame(rows, "band long, doc_id long, comp long, size long")).select("band", "doc_id", "comp", "block", "other").collect()
        for band in (5, 6):
            comp = {r["block"]: {q["comp"] for q in got if (q["band"], q["block"]) == (band, r["block"])} for r in got if r["band"] == band}
            met = {(r["block"], r["other"]) for r in got if r["band"] == band}
            # Every two members of different components lie in blocks that meet.
            assert {(a, b) for a in comp for b in comp if len(comp[a] | comp[b]) > 1} <= met
            assert all(len(comp[a] | comp[b]) > 1 for a, b in met if a in comp and b in comp)
        dealt[n] = sum(r["band"] == 5 for r in got)
    assert dealt[400] == 400 + 2 * 26 and dealt[800] == 800 + 2 * 51


def test_drop_keeps_one_row_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z")], "doc_id long, text string, n string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e f", "x"), (3, None, "z")]


def test_sketches_and_tiles():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])  # similarity 9/11
    apart = lambda a, b: int(np.bitwise_count((odd_sketch(samples(a)) ^ odd_sketch(samples(b))).view(np.uint64)).sum())
    assert apart(x, x) == 0 and apart(x, y) <= minhash.sketch_limit(80, 100) < apart(x, rng.integers(0, 2**63, 1000, dtype=np.uint64))
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [9], [], [1, 2, 3, 4], [1, 2])]
    assert linked_in_tile(sets, np.array([0, 1, 2]), np.array([3, 4]), 80, 100).tolist() == [[True, False], [False, False], [False, False]]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    vecs = [(b + rng.normal(size=16) * s).astype(np.float32).tolist() for b in base for s in (0, 0, 0.05, 0.12, 0.15, 0.2)]
    rows = [(k, v, k % 2) for k, v in enumerate(vecs)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, vecs[0], None), (105, [2 * x for x in vecs[0]], 0), (106, [1.0, 2.0], 0), (107, [2.0, 4.0], 0), (108, [1e-30, 3e38], 0), (109, [1e-30, 3e38], 0), (3, vecs[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_embeddings(df).collect()
    assert len(got) == len(rows)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    use = [(d, v, g) for d, v, g in rows[:-1] if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    link = {(a, b) for a, v, g in use for b, u, h in use if a != b and g == h and len(v) == len(u) and cosine(v, u) >= 0.98}
    want = groups(sorted(r[0] for r in rows[:-1]), lambda a, b: (a, b) in link)
    for r in got:
        n = sum(a == r["vec_id"] for a, _ in link) + (r["vec_id"] == 3 or (3, r["vec_id"]) in link)
        assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (want[r["vec_id"]] == r["vec_id"])
        assert r["n_links"] == n, r
    assert near_embeddings(df.limit(0)).count() == 0


def test_embeddings_in_tiles_with_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 24))
    vecs = [(b + rng.normal(size=24) * s).tolist() for b in base for s in (0.0, 0.05, 0.1, 0.3)]
    vecs[5] = vecs[4]
    # Of two axes' sum and one axis, scaled so that the cosine is 0.8 exactly.
    rows = [(k, v, "a", k, k, "x") for k, v in enumerate(vecs)] + [(3, vecs[20], "a", 0, 0, "x"), (900, [3.0, 4.0], "b", 0, 0, "x"), (901, [0.0, 1.0], "b", 0, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep long, copies long, class string")
    whole = sorted(map(tuple, near_embeddings(df).collect()))
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, near_embeddings(df).collect())) == whole
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in enumerate(vecs)}
    for vec_id, n_links, *_ in whole:
        if vec_id < 900 and vec_id not in (3, 20):
            others = [(k, u) for k, u in unit.items() if k != vec_id] + ([(-1, unit[20])] if vec_id != 20 else [])
            assert n_links == sum(float(unit[vec_id] @ u) >= 0.98 for _, u in others)
    assert [r[1:3] for r in near_embeddings(df, 0.8).filter("vec_id >= 900").orderBy("vec_id").collect()] == [(1, 900), (1, 900)]


def test_bound_loses_no_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=x.shape) * 0.2 / 8 * rng.uniform(6, 10, size=(300, 1)) / 8
    i, j = linked_pairs(x, y, 0.98)
    c = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(c >= 0.98)), strict=True))


def plain_bytes(rows, length=50):
    first, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for k in range(len(t) - length + 1) if d is not None else ():
            w = t[k : k + length]
            first[w] = min(first.get(w, d), d)
    for d, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1) if d is not None else ():
            if first[t[k : k + length]] < d:
                gone[k : k + length] = [True] * length
        out.append((d, len(t), sum(gone), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def plain_words(rows, length=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1) if d is not None else ():
            x = tuple(w[k : k + length])
            if x in seen:
                gone[k : k + length] = [True] * length
            seen.add(x)
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3) + rng.choice(["", "é", "🙂", "x"])
    text = lambda n: " ".join(word() + str(rng.randrange(60)) for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 25, 60, 200)]
    rows = [(k, " ".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randrange(1, 30)) for _ in range(8))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "a " * 300), (53, "a " * 200), (54, rows[3][1]), (None, rows[3][1]), (2000, shared[5] + "\n" + shared[5]), (60, text(8000)), (61, "\x00" * 120), (62, "x" + "\x00" * 70), (63, "ab " * 3000), (64, "ab " * 2000 + "c"), (65, "z" * 5000), (66, "z" * 5000 + "y" + "z" * 80)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_substrings_against_plain_versions(spark, monkeypatch, hot):
    from tessella.llm import passages as frame

    monkeypatch.setattr(frame, "HOT", hot)
    monkeypatch.setattr(frame, "CHUNK_BYTES", {True: 9000, False: 9000})
    monkeypatch.setattr(frame, "BUCKET_SEGMENTS", {True: 40, False: 40})
    rows = passages(4)
    df = spark.createDataFrame([(d, t, "own") for d, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_words(df).collect()), key=str)
    assert got == plain_words(rows)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in remove_bytes(df).collect()), key=str)
    assert got == plain_bytes(rows)
    assert remove_words(df.limit(0)).count() == 0 and remove_bytes(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == remove_bytes(df.filter("doc_id = 51")).selectExpr("sha2(kept, 256) AS h").first()["h"]


def test_a_run_of_one_character_is_one_piece(spark):
    df = spark.createDataFrame([(k, "-" * 400_000 + str(k)) for k in range(3)] + [(9, "ha " * 100_000)], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in remove_bytes(df).collect()}
    assert got[0][0] == 0 and got[9][0] == 0 and got[1] == (400_000, b"1") and got[2] == (400_000, b"2")
    assert [r["n_removed"] for r in remove_words(df.filter("doc_id = 9")).collect()] == [99_999]


def test_progressions_and_blocks(monkeypatch):
    from tessella.llm import passages as frame

    rng = np.random.default_rng(3)
    for x in ([], [5], [1, 2, 3, 5, 7, 9, 20], np.flatnonzero(rng.random(300) < 0.5)):
        x = np.array(x, np.int64)
        rows = frame.progressions(x, rng.random(len(x)) < 0.1)
        assert [a + k * s for a, s, n in rows.tolist() for k in range(n)] == x.tolist()
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    units, counts, skip = frame.Units(20, 5, True, True, None), np.array([3000, 10, 1990]), np.zeros(3, bool)
    whole = frame.anchored(units, h, counts, skip)
    monkeypatch.setattr(frame, "_BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, frame.anchored(units, h, counts, skip), strict=True))


def test_words_alike_in_half_a_hash_are_told_apart(spark):
    hashes, seen, alike = minhash.WordHashes(), {}, None
    for k in range(10**6):
        word = f"n{k}"
        top = int(hashes[word.encode()]) >> 32
        if top in seen:
            alike = seen[top], word
            break
        seen[top] = word
    # The word that differs stands at each place of a window, so some anchors lie beside it.
    rows = [(2 * at + which, " ".join(word if k == at else f"t{at}w{k}" for k in range(20))) for at in range(20) for which, word in enumerate(alike)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_words(df).collect()) == [(d, 20, 0, t) for d, t in rows]
