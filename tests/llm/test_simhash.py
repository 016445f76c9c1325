import random
import re

import xxhash
from pyspark.sql import functions as F

from skein.llm import components, simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest key reachable over pairs within two bits, by comparing all."""
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "É", "delta", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(80)]
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(3000))
    near = [" ".join("changed" if i == k else w for i, w in enumerate(long.split())) for k in (5, 900)]
    return [*base, long, *near, "", None, " \t\x0b\n", "a", "a b", "A\x0bB", "a\u00a0b c d"]


def test_fingerprints(spark):
    data = list(enumerate(texts()))
    for count in (1, 3):
        got = simhash.with_fingerprints(spark.createDataFrame(data, SCHEMA), count=count, into="fps").collect()
        assert {r.doc_id: r.fps[0] & (1 << 64) - 1 for r in got} == {i: plain_fingerprint(t) for i, t in data}
        assert all(len(r.fps) == count for r in got)


def test_components_of_texts(spark):
    data = [(1000 - i, t) for i, t in enumerate(texts())]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == groups({d: plain_fingerprint(t) for d, t in data})
    assert len(set(got.values())) < len(got) - 10


def edited(words, rate, rng):
    return [f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def test_edited_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))] for _ in range(60)]
    data = [(i, " ".join(w)) for i, w in enumerate(base)]
    data += [(100 + i, " ".join(edited(w, 0.01, rng))) for i, w in enumerate(base[:30])]
    data += [(200 + i, " ".join(edited(w, 0.25, rng))) for i, w in enumerate(base[:30])]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), count=8).collect()}
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    like = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    texts_ = dict(data)
    alike = [i for i in range(30) if like(texts_[i], texts_[100 + i]) >= 0.85]
    assert len(alike) > 15 and sum(got[100 + i] == i for i in alike) >= 0.9 * len(alike)
    assert all(got[i] == i for i in range(60)) and all(got[200 + i] == 200 + i for i in range(30))


def test_many_copies_of_one_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(300)}" for _ in range(200)]
    data = [(i, " ".join(edited(words, 0.008, rng))) for i in range(300)]
    got = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), count=8).groupBy("component").count().collect()
    assert max(r["count"] for r in got) >= 290


def clusters(seed):
    """Fingerprints in dense clusters, chains of two-bit steps, and alone."""
    rng = random.Random(seed)
    out = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        out |= {centre ^ (1 << rng.randrange(64)) for _ in range(30)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        out.add(chain)
    return sorted(out | {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63})


def flipped(fps, bits):
    """Fingerprints with the given bits of all of them changed."""
    out = [x & (1 << 64) - 1 for x in fps]
    for bit in bits:
        out[bit // 64] ^= 1 << bit % 64
    return [x - (1 << 64) if x >> 63 else x for x in out]


def names(spark, monkeypatch, vectors):
    """Component, by position, of texts with the given fingerprints."""
    held = lambda docs, text_col, shingle, count: docs.withColumn("_fps", F.from_json(text_col, "array<long>"))
    monkeypatch.setattr(simhash, "with_fingerprints", held)
    data = [(i, str(v)) for i, v in enumerate(vectors)]
    return {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), count=8).collect()}


def test_pairs_that_are_not_near_the_first_of_their_key(spark, monkeypatch):
    rng = random.Random(11)
    base = flipped([0] * 8, [b for b in range(512) if rng.random() < 0.5])
    for n in (20, 40):  # fewer and more texts than a key may hold without being split
        # all share the first half of the first fingerprint; a pair shares one quarter of the third too, and differs by 58 bits
        far = [flipped(base, rng.sample(range(32, 512), 200)) for _ in range(n)]
        near = [flipped(v, [16 * q + b for q in range(2, 32) if q != 8 for b in rng.sample(range(16), 2)]) for v in far]
        got = names(spark, monkeypatch, far + near)
        assert got == {i: i % n for i in range(2 * n)}


def test_pairs_of_a_crowded_key_that_agree_in_nothing_else(spark, monkeypatch):
    rng = random.Random(13)
    base = flipped([0] * 8, [b for b in range(512) if rng.random() < 0.5])
    # all share the first half of the first fingerprint; a pair differs by two bits in every other quarter
    far = [flipped(base, rng.sample(range(32, 512), 200)) for _ in range(50)]
    near = [flipped(v, [16 * q + b for q in range(2, 32) for b in rng.sample(range(16), 2)]) for v in far]
    assert names(spark, monkeypatch, far + near) == {i: i % 50 for i in range(100)}


def test_links_of_all_pairs_that_share_a_key(spark):
    """Small and large blocks, whole components or single keys: always the components of all pairs of a key."""
    rng = random.Random(14)
    unsigned = lambda x: x & (1 << 64) - 1
    quarters = lambda v: [unsigned(x) >> 16 * i & 0xFFFF for x in v for i in range(4)]
    bits = lambda a, b: sum((unsigned(x) ^ unsigned(y)).bit_count() for x, y in zip(a, b))
    vectors = []
    for _ in range(3):
        one = flipped([0] * 2, rng.sample(range(128), 64))
        vectors += [flipped(one, rng.sample(range(128), rng.randrange(3, 20))) for _ in range(50)]
    vectors += [flipped(vectors[k], [*rng.sample(range(32, 128), 12)]) for k in range(0, 150, 5)]
    first = {v[0]: v for v in vectors}  # texts of one first fingerprint are one anyway
    vectors = sorted(first.values())
    keys = [{(n, q[i], q[j]) for n, (i, j) in enumerate(simhash._key_quarters(2))} for q in map(quarters, vectors)]
    root = {v[0]: v[0] for v in vectors}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            if keys[i] & keys[j] and bits(a, vectors[j]) <= 15:
                x, y = find(a[0]), find(vectors[j][0])
                root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    assert 3 < len(set(want.values())) < len(want) - 50
    df = spark.createDataFrame([(v[0], v, v) for v in vectors], "fp long, fps array<long>, blocks array<long>")
    none = spark.createDataFrame([], "a long, b long")
    for block, per_row in ((1024, 0), (7, 0), (5, 64)):
        links = simhash.similar_links(df, 2, none, spread=7.75, block=block, per_row=per_row)
        got = {k: k for k in root} | {r.node: r.component for r in components.connected_components(links).collect()}
        if per_row == 0:
            assert got == want
        # comparing whole components finds pairs beyond those of a key, never fewer
        assert all(got[a] == got[b] for a, b in want.items())
        assert all(r.a in first and r.b in first for r in links.collect())


def test_every_text_of_a_first_fingerprint_is_a_candidate(spark, monkeypatch):
    rng = random.Random(12)
    one = flipped([0] * 8, [b for b in range(512) if rng.random() < 0.5])
    same = [one[0], *flipped(one, rng.sample(range(64, 512), 200))[1:]]
    near = [flipped(v, rng.sample(range(64), 8) + rng.sample(range(64, 512), 20)) for v in (one, same)]
    assert names(spark, monkeypatch, [one, same, *near]) == {i: 0 for i in range(4)}


def test_links_whether_few_or_many_share_a_block(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = {signed(x): x for x in clusters(1)}
    want = groups(prints)
    df = spark.createDataFrame([(k,) for k in prints], "fp long")
    for paired in (1, 8, 10_000):
        found = components.connected_components(simhash.hamming_links(df, paired=paired)).collect()
        got = {k: k for k in prints} | {r.node: r.component for r in found}
        assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_tables(spark, monkeypatch):
    """However many rounds and edges are left to the driver, the components are the same; short tables take one round, which was two at least."""
    rng = random.Random(22)
    edges = [(i, i + 1) for i in range(-30, 60)] + [(1000, k) for k in range(900, 1100)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(190)] + [(5, 5)]
    met = {}
    for a, b in edges:
        if a != b:
            met.setdefault(a, set()).add(b)
            met.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(met):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += met[y]
    tables = []
    held = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: tables.append(df) or held(df))
    df = spark.createDataFrame(edges, "a long, b long")
    found = components.connected_components(df)
    assert len(tables) <= 3
    assert {r.node: r.component for r in found.collect()} == want
    for rest in (0, 20):
        assert {r.node: r.component for r in components.connected_components(df, rest).collect()} == want


def test_null_ids_repeats_and_empty(spark):
    data = [(None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (None, "alone here now then")]
    got = [(str(r.id), r.component) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()]
    assert [g for g in got if g[0] == "5"] == [("5", 5), ("5", 5)] and ("None", 5) in got and ("None", None) in got
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    data = [(3, "same text here", "b"), (2, "same text here", "a"), (9, "Same TEXT here", "c"), (4, "quite another matter", "d"), (None, "same text here", "e")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, component string"))
    assert sorted((str(r.doc_id), r.component) for r in out.collect()) == [("2", "a"), ("4", "d"), ("None", "e")]


def test_repeated_ids_lose_no_text_and_leave_one_row(spark):
    data = [(1, "same text here", "a"), (5, "same text here", "b"), (5, "quite another matter", "c"), (7, "a third thing altogether", "e"), (7, "a third thing altogether", "d"), (7, None, "f")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, tag string"))
    assert sorted((r.doc_id, r.tag) for r in out.collect()) == [(1, "a"), (5, "c"), (7, "d"), (7, "f")]


def pairs_by_similarity(data, least):
    """(similarity, id, id) of all pairs of different texts whose five-word shingles are that similar, by comparing all that share one."""
    texts = {}
    for i, t in sorted(data):
        texts.setdefault(" ".join((t or "").lower().split()), i)
    shingles = {}
    for t, i in texts.items():
        w = t.split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    holders = {}
    for i, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(a, b) for ids in holders.values() if len(ids) <= 60 for a in ids for b in ids if a < b}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    return [(j, a, b) for a, b in met if (j := like(a, b)) >= least]


def test_recall_of_the_pipelines_form_on_the_large_table(spark):
    from skein.llm import pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    pairs = pairs_by_similarity([tuple(r) for r in docs.collect()], 0.5)
    found = simhash.near_duplicates(docs, shingle=pipeline.SHINGLE, count=pipeline.FINGERPRINTS, block_shingle=pipeline.BLOCK_SHINGLE, spread=simhash.SPREAD_FIVE)
    got = {r.id: r.component for r in found.collect()}
    alike = [got[a] == got[b] for j, a, b in pairs if j >= 0.8]
    assert len(alike) > 40 and sum(alike) >= 0.9 * len(alike)
    near = {x for _, a, b in pairs for x in (a, b)}
    texts = {}
    for r in docs.collect():
        texts.setdefault(" ".join((r.text or "").lower().split()), r.doc_id)
    by = {}
    for i in texts.values():
        by.setdefault(got[i], []).append(i)
    assert all(i in near for ids in by.values() if len(ids) > 1 for i in ids)


def test_recall_within_crowded_keys(spark):
    """Copies of one text, each in two versions: most texts meet in the same keys."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(400)}" for _ in range(250)]
    data = []
    for i in range(120):
        far = edited(base, 0.10, rng)
        data += [(2 * i, " ".join(far)), (2 * i + 1, " ".join(edited(far, 0.015, rng)))]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), shingle=5, count=8, block_shingle=2, spread=simhash.SPREAD_FIVE).collect()}
    pairs = [(a, b) for j, a, b in pairs_by_similarity(data, 0.8)]
    assert len(pairs) > 80 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
