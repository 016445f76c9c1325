import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_round_trip(data):
    payload = m.padded(data)
    file = m.mux(payload)
    media = m.parse(file)
    assert b"".join(file[p.offset : p.offset + p.size] for p in media.packets) == payload
    assert [p.timestamp_ns for p in media.packets] == sorted(p.timestamp_ns for p in media.packets)
    assert media.duration_ns == len(payload) * 1000 // m.RATE * 1_000_000
    assert m.read_features(file)[0] == len(payload)


@pytest.mark.parametrize("n,want", [(0, 64), (1, 64), (64, 64), (65, 128)])
def test_padding(n, want):
    assert len(m.padded(b"x" * n)) == want


def block(flags, lace, body):
    return m._element(m.SIMPLE_BLOCK, m._size(1) + (5).to_bytes(2, "big") + bytes([flags]) + lace + body)


def file_of(clusters):
    track = m._uint(m.TRACK_NUMBER, 1) + m._element(m.CODEC_ID, b"X")
    return m._element(m.EBML, b"") + m._element(m.SEGMENT, m._element(m.TRACKS, m._element(m.TRACK_ENTRY, track)) + clusters)


@pytest.mark.parametrize(
    "flags,lace,sizes",
    [(0x82, bytes([2, 255, 45, 3]), [300, 3, 7]), (0x84, bytes([2]), [4, 4, 4]), (0x86, bytes([2]) + m._size(300) + m._size(-297 + (1 << 13) - 1, 2), [300, 3, 7]), (0x80, b"", [9])],
)
def test_kinds_of_lacing(flags, lace, sizes):
    body = b"".join(bytes([k]) * n for k, n in enumerate(sizes))
    file = file_of(m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 100) + block(flags, lace, body)))
    packets = m.parse(file).packets
    assert [p.size for p in packets] == sizes and packets[0].timestamp_ns == 105_000_000
    assert all(file[p.offset : p.offset + p.size] == bytes([k]) * n for k, (p, n) in enumerate(zip(packets, sizes)))


def test_block_groups_and_clusters_of_unknown_size():
    group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, m._size(1) + b"\0\0\0abc"))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + m._uint(m.TIMESTAMP, 1) + group
    packets = m.parse(file_of(unknown + m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 2) + group))).packets
    assert [(p.cluster, p.timestamp_ns, p.keyframe) for p in packets] == [(0, 1_000_000, False), (1, 2_000_000, False)]


@pytest.mark.parametrize("data", [b"", b"not a file", m.mux(m.padded(b"abc"))[:-5]])
def test_what_is_no_file_is_refused(data):
    with pytest.raises(ValueError):
        m.parse(data)


def test_query_columns(spark):
    texts = [None, "", "abc", "é" * 5000, "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in m.media_features(m.with_media(df)).collect()}
    for i, t in enumerate(texts):
        payload = m.padded((t or "").encode())
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = m.mux(payload)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[2].feature == got[4].feature and got[0].media_sha256 == got[1].media_sha256


def test_packet_table(spark):
    df = m.with_media(spark.createDataFrame([(1, "x" * 5000), (2, None)], "doc_id long, text string"))
    rows = m.packet_table(df).orderBy("doc_id", "offset").collect()
    assert [r.size for r in rows] == [1024, 1024, 1024, 1024, 960, 64]
    assert [r.timestamp_ns // 1_000_000 for r in rows] == [0, 128, 256, 384, 512, 0]
    assert m.packet_table(df.where("doc_id < 0")).count() == 0
    assert m.packet_table(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_damaged_files_raise_value_errors_only(data):
    file = bytearray(m.mux(m.padded(b"abc" * 900)))
    for _ in range(data.draw(st.integers(1, 4))):
        file[data.draw(st.integers(0, min(len(file), 300) - 1))] = data.draw(st.integers(0, 255))
    assert len(m.features_or_error(bytes(file))) == 9
    try:
        m.parse(bytes(file))
    except ValueError:
        pass


def test_a_corrupt_file_does_not_stop_the_others(spark):
    good = bytes(m.mux(m.padded(b"abc")))
    df = spark.createDataFrame([(1, good, 5), (2, b"junk", 5), (3, None, 5), (4, good[:-5], 5)], "doc_id long, media binary, packets int")
    got = {r.doc_id: r for r in m.media_features(df).collect()}
    assert got[1].error is None and got[1].packets == 1 and got[1].payload_bytes == 64
    assert got[2].error and got[4].error and got[2].payload_sha256 is None and got[3].error is None and got[3].media_bytes is None
    rows = {r.doc_id: r for r in m.packet_table(df).collect()}
    assert set(rows) == {1, 2, 4} and rows[2].error and rows[2].size is None and rows[1].error is None


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", "old", 7, "x")], "doc_id long, text string, media string, payload_bytes long, feature string")
    out = m.media_features(m.with_media(df))
    assert out.first().payload_bytes == 64 and out.columns.count("feature") == 1 and "media" not in out.columns
    assert m.media_features(m.with_media(df.limit(0))).count() == 0
