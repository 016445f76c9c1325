"""Media columns: Matroska files as binary values.

The muxer stores bytes as 8-bit PCM audio: frames of a fixed number of samples,
several to a SimpleBlock by lacing, blocks in clusters, and a cue for each cluster.
The parser reads any such file element by element: variable-length identifiers and
sizes, clusters of known or unknown size, SimpleBlocks and BlockGroups, and all
three kinds of lacing. It gives one row for each packet, with track, timestamp and
byte range, so a reader can fetch the bytes of a stretch of time alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, table

# Fixed values of the format: element identifiers.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

RATE = 8_000
FRAME = 1_024
LACED = 8
BLOCKS_A_CLUSTER = 16
PAD = 64


class Packet(NamedTuple):
    cluster: int
    track: int
    timestamp_ns: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    tracks: dict
    packets: list
    clusters: list
    cues: list
    duration_ns: int


def _size(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length size of the least width, or of the given one."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock: no lacing for one frame, fixed-size lacing for equal sizes, EBML lacing otherwise."""
    sizes = [len(f) for f in frames]
    flags, lace = 0x80, b""
    if len(frames) > 1:
        lace = bytes([len(frames) - 1])
        if len(set(sizes)) == 1:
            flags |= 0x04
        else:
            flags |= 0x06
            lace += _size(sizes[0])
            for a, b in zip(sizes, sizes[1:-1]):
                width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
                lace += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return _element(SIMPLE_BLOCK, _size(track) + struct.pack(">hB", relative, flags) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds the bytes as unsigned 8-bit samples. Equal bytes give equal files."""
    ms = lambda samples: samples * 1000 // RATE
    info = _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", ms(len(payload)))) + _element(MUXING_APP, b"skein") + _element(WRITING_APP, b"skein")
    audio = _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + _element(AUDIO, audio)
    parts = [_element(INFO, info), _element(TRACKS, _element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    held = FRAME * LACED * BLOCKS_A_CLUSTER
    for start in range(0, len(payload), held):
        body = [_uint(TIMESTAMP, ms(start))]
        for b in range(start, min(start + held, len(payload)), FRAME * LACED):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACED, len(payload)), FRAME)]
            body.append(_block(1, ms(b) - ms(start), frames))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms(start)) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    head = _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2)
    return _element(EBML, head) + _element(SEGMENT, b"".join(parts))


def _number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None for a size that is unknown."""
    if at >= len(data):
        raise ValueError(f"the file ends within a number at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    n = raw & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _elements(data: bytes, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, start, end) of each element's body. A body of unknown size ends with its parent's or before the next top-level element."""
    while at < stop:
        kind, body = _number(data, at, keep_marker=True)
        size, body = _number(data, body)
        if size is None:
            end = stop if kind == SEGMENT else _unknown_end(data, body, stop)
        else:
            end = body + size
        if end > stop:
            raise ValueError(f"the element at byte {at} goes beyond its parent")
        yield kind, body, end
        at = end


def _unknown_end(data: bytes, at: int, stop: int) -> int:
    while at < stop:
        kind, body = _number(data, at, keep_marker=True)
        if kind in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, body = _number(data, body)
        at = body + (size or 0)
    return stop


def _frames(data: bytes, at: int, stop: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, stop - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        each, rest = divmod(stop - at, n)
        if rest:
            raise ValueError("fixed-size lacing does not divide the block")
        return [(at + k * each, each) for k in range(n)]
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = _number(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw, at = _number(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames go beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Tracks, packets, cluster positions and cues of a file. Raises ValueError, and nothing else, for what isn't Matroska."""
    try:
        return _parse(data)
    except (IndexError, KeyError, OverflowError, struct.error) as e:
        raise ValueError(f"a broken element: {e!r}") from e


def _parse(data: bytes) -> Media:
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    tracks, packets, clusters, cues, scale, duration = {}, [], [], [], 1_000_000, 0.0
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    for kind, begin, end in top:
        if kind != SEGMENT:
            continue
        for part, a, b in _elements(data, begin, end):
            if part == INFO:
                for k, x, y in _elements(data, a, b):
                    scale, duration = (uint(x, y), duration) if k == TIMESTAMP_SCALE else (scale, real(x, y)) if k == DURATION else (scale, duration)
            elif part == TRACKS:
                for k, x, y in _elements(data, a, b):
                    if k == TRACK_ENTRY:
                        own = {kk: (xx, yy) for kk, xx, yy in _elements(data, x, y)}
                        tracks[uint(*own[TRACK_NUMBER])] = {"codec": data[slice(*own[CODEC_ID])].decode(), "frame_ns": uint(*own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0}
            elif part == CLUSTER:
                clusters.append((a, b))
                base = 0
                for k, x, y in _elements(data, a, b):
                    if k == TIMESTAMP:
                        base = uint(x, y)
                    elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                        blocks = [(x, y)] if k == SIMPLE_BLOCK else [(xx, yy) for kk, xx, yy in _elements(data, x, y) if kk == BLOCK]
                        for x1, y1 in blocks:
                            track, at = _number(data, x1)
                            relative, flags = struct.unpack(">hB", data[at : at + 3])
                            step = tracks.get(track, {}).get("frame_ns", 0)
                            for n, (offset, size) in enumerate(_frames(data, at + 3, y1, flags >> 1 & 3)):
                                packets.append(Packet(len(clusters) - 1, track, (base + relative) * scale + n * step, bool(flags & 0x80) and k == SIMPLE_BLOCK, offset, size))
            elif part == CUES:
                for k, x, y in _elements(data, a, b):
                    if k == CUE_POINT:
                        own = {kk: (xx, yy) for kk, xx, yy in _elements(data, x, y)}
                        place = {kk: (xx, yy) for kk, xx, yy in _elements(data, *own[CUE_TRACK_POSITIONS])}
                        cues.append((uint(*own[CUE_TIME]) * scale, uint(*place[CUE_TRACK]), begin + uint(*place[CUE_CLUSTER_POSITION])))
    return Media(tracks, packets, clusters, cues, int(duration * scale))


def padded(data: bytes | None) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    data = data or b""
    return data + b"\0" * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def with_media(docs: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with the text's UTF-8 bytes, padded, as a Matroska file.

    A null text counts as empty; equal texts, repeated rows too, have equal files. A text is stored whole, so a very long
    one is held by one task. An input column named ``into`` gives way to the result. An empty table gives an empty one.
    """

    bound_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def store(data: pd.Series) -> pd.Series:
        return data.map(lambda x: mux(padded(x)))

    return docs.withColumn(into, store(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


PACKETS = "cluster int, track int, timestamp_ns long, keyframe boolean, offset long, size long"


def packet_table(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: the file's id, cluster, track, timestamp, and byte range within the file, and ``error``, null.

    A null file has no packets, nor has one without clusters. A file that isn't Matroska has one row, with an error that says what
    is wrong and nulls. Repeated rows give repeated packets; other columns are not read, so none clashes; an empty table gives an empty one.
    """

    fields = f"{PACKETS}, error string".replace(" ", ":").replace(",:", ",")

    def of(file: bytes | None) -> list[dict]:
        try:
            return [] if file is None else [{**p._asdict(), "error": None} for p in parse(file).packets]
        except ValueError as e:
            return [{"error": str(e)}]

    @F.pandas_udf(f"array<struct<{fields}>>")
    def packets(files: pd.Series) -> pd.Series:
        return files.map(of)

    return files.select(F.col(id_col), F.explode(packets(media_col)).alias("_p")).select(id_col, "_p.*")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets int, duration_ms long, feature string, error string"


def read_features(data: bytes) -> tuple:
    """What the stored file holds: digests of the samples fetched by the packets' byte ranges, and a loudness profile."""
    media = parse(data)
    heads = {a for a, _ in media.clusters}
    for _, track, position in media.cues:  # each cue must lead to a cluster
        _, body = _number(data, position, keep_marker=True)
        if _number(data, body)[1] not in heads or track not in media.tracks:
            raise ValueError(f"the cue to byte {position} leads nowhere")
    view = memoryview(data)
    payload = b"".join(view[p.offset : p.offset + p.size] for p in media.packets)
    samples = np.frombuffer(payload, dtype=np.uint8)
    edges = np.linspace(0, len(samples), 9).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    profile = "-".join(str(int((total[b] - total[a]) // max(1, b - a))) for a, b in zip(edges, edges[1:]))
    codec = next(iter(media.tracks.values()), {"codec": ""})["codec"]
    feature = f"{codec};tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};levels={profile}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(),
        len(media.packets), media.duration_ns // 1_000_000, feature, None,
    )


def features_or_error(data: bytes | None) -> tuple:
    """read_features, or nulls and what is wrong with the file; a null file has nulls alone."""
    try:
        return (None,) * 9 if data is None else read_features(data)
    except ValueError as e:
        return (*(None,) * 8, str(e))


def media_features(files: DataFrame, media_col: str = "media") -> DataFrame:
    """``files`` without the media column, with what reading it back gives.

    A file that isn't Matroska has nulls and an ``error``, a null file nulls alone. Repeated rows have equal results. Input columns named like a
    result column give way to it. An empty table gives an empty one.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kept = [c for c in files.columns if c not in (*names, media_col)]

    @F.pandas_udf(FEATURES)
    def features(stored: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([features_or_error(x) for x in stored], columns=names, dtype=object)
        return out.astype({n: "Int64" for n in ("payload_bytes", "tail_crc32", "media_bytes", "packets", "duration_ms")})

    return files.select(*kept, features(media_col).alias("_f")).select(*kept, "_f.*")


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as Matroska audio, read back from its packets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    files = with_media(docs).drop("text")
    return media_features(files).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "duration_ms"
    )
