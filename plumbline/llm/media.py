"""Media columns: MPEG audio (operator 5).

`write` stores bytes as an MPEG-1 Layer III stream in a binary column: an ID3v2.3 tag (TXXX frames with the payload's
size and name), an information frame with the variable-bitrate table (frames, bytes, 100 seek points), then frames of
48 kHz mono with a CRC. The payload rides in the frames' ancillary data behind empty side information, so a decoder
plays silence; every frame takes 320 kbit/s but the last, which takes the smallest rate that holds what is left.

`read` takes MPEG-1, 2 and 2.5 streams of all three layers: it parses ID3v2 text frames and a trailing ID3v1 tag,
resynchronises on frame headers (a header counts if another one of the same kind, or the end, follows where it says),
reads the variable-bitrate table (Xing and Info: frames, bytes, seek points, quality; VBRI: the same and its own seek
table), verifies the CRC of Layer III frames, and gives the exact duration (samples over the sample rate), every frame's
offset, and the payload. A frame whose CRC is wrong gives no payload. `vbr_ok` says whether the table's totals are those
that were found (null without a table), `intact` that nothing was skipped, no CRC is wrong and no total differs.

Cases: null bytes count as empty; an empty stream, or one without frames, has no frames, no payload and duration 0;
equal payloads give equal streams; repeated rows and other columns pass through, results replace columns of the same
name; an empty table gives an empty table. Long payloads are more frames; memory is that of one row's bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import byte_chunks, clean_text, table

#: Bytes taken at a time inside a task.
CHUNK_BYTES = 4_000_000
#: kbit/s by index, Hz by index (fixed values of the format): MPEG-1 Layers I, II, III, then MPEG-2 and 2.5 Layer I, and II and III.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by the version's bits: 1, 2, 2.5
KBITS = RATES[1, 3]
HEAD = 4 + 2 + 17


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_crcs: dict[bytes, int] = {}


def _crc(data: bytes) -> int:
    """crc16; silent frames repeat a few headers, whose values are kept."""
    if data not in _crcs:
        if len(_crcs) > 10_000:
            _crcs.clear()
        _crcs[data] = crc16(data)
    return _crcs[data]


def _frame(rate: int, body: bytes) -> bytes:
    """A 48 kHz mono frame with CRC: its length is 3 bytes a kbit/s."""
    head = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return (head + struct.pack(">H", _crc(head[2:] + side)) + side + body).ljust(3 * KBITS[rate], b"\0")


def write_stream(payload: bytes) -> bytes:
    """The stream that holds the payload."""
    room = 3 * KBITS[14] - HEAD
    frames = [_frame(14, payload[i : i + room]) for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(payload) - len(payload) % room :]:
        frames.append(_frame(next(i for i in range(1, 15) if 3 * KBITS[i] - HEAD >= len(rest)), rest))
    text = b"".join(b"TXXX" + struct.pack(">IH", len(v), 0) + v for v in (b"\0payload_bytes\0%d" % len(payload), b"\0title\0payload"))
    size = len(text)
    tag = b"ID3\x03\0\0" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + text
    total = 3 * KBITS[5] + sum(map(len, frames))
    seek, at, offsets = bytearray(), 3 * KBITS[5], []
    for f in frames:
        offsets.append(at)
        at += len(f)
    for i in range(100):
        seek.append(min(255, 256 * offsets[i * len(frames) // 100] // total) if frames else 0)
    return tag + _frame(5, b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(seek)) + b"".join(frames)


class Header(NamedTuple):
    size: int
    hertz: int
    samples: int
    side: int  # bytes of side information (Layer III)
    crc: int  # 1 if a CRC follows
    layer: int
    kind: int  # version, layer and sample rate: the same in all frames of a stream


def header(b: bytes, at: int) -> Header | None:
    """The MPEG audio frame header there, if it is one."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or not 1 <= rate <= 14 or hz == 3:
        return None
    first = version == 3
    bits, hertz, pad = 1000 * RATES[1 if first else 2, layer][rate], HERTZ[version][hz], b[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    mono = b[at + 3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else 9 if mono else 17
    return Header(size, hertz, samples, side, 1 - (b[at + 1] & 1), layer, version << 4 | layer << 2 | hz)


def id3(b: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and where the audio begins and ends: an ID3v2 tag before it, an ID3v1 tag after it."""
    tags, start, end = {}, 0, len(b)
    if b[-128:-125] == b"TAG" and len(b) >= 128:
        end -= 128
        tags |= {n: v for n, a, z in (("v1_title", 3, 33), ("v1_artist", 33, 63), ("v1_album", 63, 93), ("v1_year", 93, 97)) if (v := b[end + a : end + z].rstrip(b"\0 ").decode("latin-1"))}
    if b[:3] == b"ID3" and len(b) >= 10:
        safe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
        p, start = 10, min(end, 10 + safe(b[6:10]) + 10 * (b[5] >> 4 & 1))
        while p + 10 <= start and b[p]:
            n = safe(b[p + 4 : p + 8]) if b[3] == 4 else int.from_bytes(b[p + 4 : p + 8], "big")
            if not 0 < n <= start - p - 10:
                break
            if b[p : p + 1] == b"T":
                coding = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[p + 10], "latin-1")
                text = b[p + 11 : p + 10 + n].decode(coding, "replace").rstrip("\0")
                name, _, value = text.partition("\0") if b[p : p + 4] == b"TXXX" else (b[p : p + 4].decode("latin-1"), "", text)
                tags[name] = value.lstrip("\ufeff")
            p += 10 + n
    return tags, start, end


def vbr_table(b: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in a frame's place, if there is one."""
    p = at + 4 + 2 * h.crc + h.side
    if b[p : p + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(b[p + 4 : p + 8], "big"), p + 8
        out = {"vbr_frames": -1, "vbr_bytes": -1, "vbr_quality": -1, "seek": []}
        for bit, name, n in ((1, "vbr_frames", 4), (2, "vbr_bytes", 4), (4, "seek", 100), (8, "vbr_quality", 4)):
            if flags & bit:
                out[name] = list(b[p : p + n]) if bit == 4 else int.from_bytes(b[p : p + n], "big")
                p += n
        if out["seek"] and out["vbr_bytes"] >= 0:
            out["seek"] = [x * out["vbr_bytes"] // 256 for x in out["seek"]]  # bytes from the table's frame on
        return out
    p = at + 36
    if b[p : p + 4] == b"VBRI" and p + 26 <= at + h.size:
        _, _, quality, size, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", b[p + 4 : p + 26])
        steps = [scale * int.from_bytes(b[p + 26 + i * width : p + 26 + (i + 1) * width], "big") for i in range(min(entries, (at + h.size - p - 26) // max(1, width)))]
        return {"vbr_frames": frames, "vbr_bytes": size, "vbr_quality": quality, "seek": list(accumulate(steps))}
    return None


def read_stream(b: bytes) -> dict:
    """What the stream holds: tags, the variable-bitrate table, frames with checksums, duration, offsets, payload."""
    out = {"vbr_frames": -1, "vbr_bytes": -1, "vbr_quality": -1, "hertz": 0, "frames": 0, "crc_checked": 0, "crc_bad": 0, "skipped": 0, "samples": 0, "seek": [], "offsets": [], "payload": b"", "vbr_ok": None}
    tags, at, end = id3(b)
    out["tag_bytes"], parts, first, begin = at, [], True, -1
    while 0 <= at < end:
        h = header(b, at)
        following = header(b, at + h.size) if h and at + h.size < end else None
        if h is None or at + h.size > end or (at + h.size < end and (following is None or following.kind != h.kind)):
            after = b.find(b"\xff", at + 1, end)
            out["skipped"] += (after if after >= 0 else end) - at
            at = after
            continue
        body, good = at + 4 + 2 * h.crc + h.side, True
        if h.crc and h.layer == 3:
            out["crc_checked"] += 1
            good = _crc(b[at + 2 : at + 4] + b[at + 6 : body]) == int.from_bytes(b[at + 4 : at + 6], "big")
            out["crc_bad"] += not good
        begin = at if begin < 0 else begin
        if first and (found := vbr_table(b, at, h)):
            out |= found
        else:
            out["offsets"].append(at)
            out["hertz"] = h.hertz
            out["samples"] += h.samples
            if good:
                parts.append(b[body : at + h.size])
        first = False
        at += h.size
    out["frames"] = len(out["offsets"])
    if out["vbr_frames"] >= 0 or out["vbr_bytes"] >= 0:
        out["vbr_ok"] = out["vbr_frames"] in (-1, out["frames"]) and out["vbr_bytes"] in (-1, end - begin)
    out["intact"] = not out["skipped"] and not out["crc_bad"] and out["vbr_ok"] is not False
    payload = b"".join(parts)
    out["payload"] = payload[: int(tags["payload_bytes"])] if tags.get("payload_bytes", "").isdigit() else payload
    out["tags"] = tags
    return out


FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("tag_bytes", "vbr_frames", "vbr_bytes", "vbr_quality", "hertz", "frames", "crc_checked", "crc_bad", "skipped", "samples")]
    + [T.StructField(n, T.BooleanType()) for n in ("vbr_ok", "intact")]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("seek", "offsets")]
    + [T.StructField("payload", T.BinaryType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]
)


def write(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """df with the payload column stored as an MPEG audio stream in place of it."""
    rest = [c for c in df.columns if c not in (payload, media)]
    df = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(payload), F.lit(b"")).alias(media))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in byte_chunks(pc.binary_length(batch.column(len(rest))).to_pylist(), CHUNK_BYTES):
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([write_stream(x) for x in part.column(len(rest)).to_pylist()], pa.binary())], names=[*rest, media])

    return df.mapInArrow(batches, df.schema)


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its streams hold, in columns named as in FEATURES."""
    names = FEATURES.names
    rest = [c for c in df.columns if c not in names and c != media]
    df = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(media), F.lit(b"")).alias(media))
    schema = T.StructType([*df.schema.fields, *FEATURES.fields])
    kinds = [pa.int64()] * 10 + [pa.bool_()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary(), pa.map_(pa.string(), pa.string())]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in byte_chunks(pc.binary_length(batch.column(len(rest))).to_pylist(), CHUNK_BYTES):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found = [read_stream(x) for x in part.column(len(rest)).to_pylist()]
                own = [pa.array([list(x[n].items()) if n == "tags" else x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*rest, media, *names])

    return df.mapInArrow(batches, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", clean_text("text").cast("binary").alias("raw"))
    size = F.octet_length("raw")
    padded = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.rpad("raw", F.greatest(F.lit(64), (F.ceil(size / 64) * 64)).cast("int"), F.lit(b"\0")).alias("payload"))
    found = read(write(padded))
    n = F.octet_length("payload")
    return found.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.lit("mpeg1-layer3"),
            *[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("hertz", "frames", "samples", "vbr_frames", "vbr_bytes", "crc_checked", "crc_bad", "skipped", "intact")],
            F.concat(F.lit("duration_ms="), F.expr("samples * 1000 div hertz")),
            F.concat(F.lit("seek_md5="), F.md5(F.array_join(F.col("seek").cast("array<string>"), ","))),
            F.concat(F.lit("offsets_md5="), F.md5(F.array_join(F.col("offsets").cast("array<string>"), ","))),
        ).alias("feature"),
        F.expr("samples / hertz").alias("duration_s"),
        F.col("offsets").alias("frame_offsets"),
    )


QUERIES = {"op5_media": op5_media}
ORACLE: dict[str, str] = {}
