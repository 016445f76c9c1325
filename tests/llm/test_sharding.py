import hashlib

from skein.llm import sharding

SCHEMA = "doc_id long, text string"


def place(doc_id, text):
    parts = [x for x in (None if doc_id is None else str(doc_id), text) if x is not None]
    return int(hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:15], 16)


def split(rows, limit, depth=0, prefix=""):
    """Splits a directory entry while it is over the limit and can be split."""
    if not rows:
        return {}
    if sum(b for _, b in rows) <= limit or len({h for h, _ in rows}) == 1:
        return {h: (prefix, sum(b for _, b in rows), len(rows)) for h, _ in rows}
    out = {}
    for bit in "01":
        out |= split([r for r in rows if str(r[0] >> (59 - depth) & 1) == bit], limit, depth + 1, prefix + bit)
    return out


def check(spark, data, limit):
    got = sharding.shard(spark.createDataFrame(data, SCHEMA), byte_limit=limit).collect()
    want = split([(place(d, t), len((t or "").encode())) for d, t in data], limit)
    assert len(got) == len(data)
    for r in got:
        assert (r.shard, r.shard_bytes, r.shard_docs) == want[place(r.doc_id, r.text)]
        assert r.depth == len(r.shard) and r.oversized == (r.shard_bytes > limit)
        assert not r.oversized or len({(x.doc_id, x.text) for x in got if x.shard == r.shard}) == 1


def test_against_splitting_one_by_one(spark):
    data = [(i, "é" * (i * 7 % 40)) for i in range(400)]
    for limit in (100, 1000, 1 << 30):
        check(spark, data, limit)


def test_long_documents_nulls_and_equal_rows(spark):
    check(spark, [(1, "x" * 5000), (2, "y" * 10), (None, None), (None, "z"), (3, None), (4, "")] + [(7, "same" * 10)] * 50, 64)


def test_deep_passes(spark):
    check(spark, [(1, "x" * 100_000)] + [(i, "abc") for i in range(2, 40)], 50_000)
    check(spark, [(i, "a" * 60) for i in range(300)], 60)


def test_empty_and_clashing_columns(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    r = sharding.shard(spark.createDataFrame([(1, "ab", "old", 3)], "doc_id long, text string, shard string, other int")).first()
    assert (r.shard, r.other, r.n_bytes) == ("", 3, 2)
