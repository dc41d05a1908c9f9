"""Media columns: MPEG audio that carries bytes, and a reader for such files.

Writer. Payloads lie in MPEG-1 layer III frames (mono, 48 kHz, with the 16-bit check of the standard). Each frame's side
information declares no coded spectrum, so any player decodes silence, and the payload fills what remains of the frame.
The bit rate of each frame is the least that holds what is left (320 kbit/s until the last), so the stream is of variable
bit rate. An ID3v2.3 tag in front gives the payload's length, and a Xing frame gives frames, bytes, a table of 100 seek
points and a check of all audio bytes.

Reader. It parses ID3v1 and ID3v2 tags, looks for frame headers, takes one as real only if another header (or the end)
follows where the frame ends, steps over damage to the next such place, verifies checks, reads Xing and VBRI tables, and
gives exact durations (1,152 or 576 or 384 samples a frame) and each frame's offset.

Frame offsets are stored whole, one number a frame. A file's sample rate is that of its first frame; the writer uses one.

Cases: null text is the empty text, whose payload is 192 spaces. Equal texts give equal values. An empty table gives an
empty result; columns other than doc_id and text are not read."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed values of the MPEG audio standard: kbit/s by (version 1, layer) or (version 2, layer), and samples a second by version.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192
SIDE = 17  # bytes of side information in a mono frame of version 1
HEAD = 4 + 2 + SIDE


def _table(poly: int, reflected: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (0 if reflected else 8)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ poly, t >> 1) if reflected else np.where(t & 0x8000, (t << 1) ^ poly, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_CRC_FRAME, _CRC_TAG = _table(0x8005, False).tolist(), _table(0xA001, True)


def frame_crc(data: bytes) -> int:
    """The check of a frame: over the last two header bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC_FRAME[c >> 8 ^ b]
    return c


_BLOCK = 256


def _places() -> np.ndarray:
    """What a byte at each place of a block adds to the block's tag check."""
    out = np.empty((_BLOCK, 256), np.uint16)
    c = _CRC_TAG.copy()
    for k in range(_BLOCK - 1, -1, -1):
        out[k] = c
        c = _CRC_TAG[c & 0xFF] ^ (c >> 8)
    return out


_PLACES = _places()
#: Where a check moves when a block of zeros follows, by its low and its high byte: the check works as if it were xored to the block's first two bytes.
_LOW, _HIGH, _BYTE = _PLACES[0].tolist(), _PLACES[1].tolist(), _CRC_TAG.tolist()


def tag_crc(data: bytes) -> int:
    """CRC-16 (reflected 0x8005, from 0) as Xing extensions use it; the bytes of a block are looked up by their place, all at once."""
    whole = len(data) // _BLOCK
    total = 0
    if whole:
        rows = np.frombuffer(data, np.uint8, whole * _BLOCK).reshape(whole, _BLOCK)
        for c in np.bitwise_xor.reduce(_PLACES[np.arange(_BLOCK), rows], axis=1).tolist():
            total = _LOW[total & 0xFF] ^ _HIGH[total >> 8] ^ c
    for b in data[whole * _BLOCK :]:
        total = _BYTE[(total ^ b) & 0xFF] ^ (total >> 8)
    return total


def payload_of(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _heads() -> list[tuple[int, bytes]]:
    """(size, header + check + side information) for each bit rate that has room for a payload, smallest first."""
    out = []
    for k, rate in enumerate(RATES[1, 3], 1):
        header = bytes([0xFF, 0xFA, k << 4 | 1 << 2, 3 << 6])
        out.append((144 * rate // 48, header + struct.pack(">H", frame_crc(header[2:] + bytes(SIDE))) + bytes(SIDE)))
    return out


_FRAMES = _heads()


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """An MPEG audio file that carries the payload."""
    room = _FRAMES[-1][0] - HEAD
    full, rest = divmod(len(payload), room)
    size, head = _FRAMES[-1]
    body = np.empty((full, size), np.uint8)
    body[:, :HEAD] = np.frombuffer(head, np.uint8)
    body[:, HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    audio = body.tobytes()
    sizes = [size] * full
    if rest:
        size, head = next(x for x in _FRAMES if x[0] - HEAD >= rest)
        audio += head + payload[full * room :] + bytes(size - HEAD - rest)
        sizes.append(size)
    info_size, info_head = next(x for x in _FRAMES if x[0] == 240)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    points = starts[np.arange(100) * len(sizes) // 100] * 256 // max(1, len(audio))
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), info_size + len(audio)) + points.astype(np.uint8).tobytes()
    lame = b"lamina1.0" + bytes(19) + struct.pack(">IH", info_size + len(audio), tag_crc(audio))
    first = info_head + xing + lame
    first += struct.pack(">H", tag_crc(first))
    words = b"\0PAYLOAD\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(words), 0) + words
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + first.ljust(info_size, b"\0") + audio


def _frame(data: bytes, at: int) -> tuple[int, int, int, int, int, bool] | None:
    """(length, samples, samples a second, kbit/s, version bits, has a check) of the header at `at`; None if it is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    rate, speed = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or speed == 3:
        return None
    kbit = RATES[1 if version == 3 else 2, layer][rate - 1]
    hertz, pad = SAMPLE_RATES[version][speed], data[at + 2] >> 1 & 1
    if layer == 1:
        return (12_000 * kbit // hertz + pad) * 4, 384, hertz, kbit, version, not data[at + 1] & 1
    samples = 576 if layer == 3 and version != 3 else 1152
    return samples // 8 * 1000 * kbit // hertz + pad, samples, hertz, kbit, version, not data[at + 1] & 1


def parse(data: bytes) -> dict:
    """Tags, tables, frames and durations of an MPEG audio file; see the module's text for how it finds frames."""
    out: dict = {"tags": {}, "frames": [], "damage": 0, "bad_checks": 0, "checked": 0, "samples": 0, "seconds": 0.0, "hertz": None, "table": None, "rates": {}}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum(b << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        p, stop = at + 10, min(end, at + 10 + size)
        while p + 10 <= stop and data[p]:
            n = struct.unpack(">I", data[p + 4 : p + 8])[0]
            name, value = data[p : p + 4].decode("latin-1"), data[p + 10 : min(stop, p + 10 + n)]
            if name[0] == "T" and value:
                parts = value[1:].decode("utf-16" if value[0] == 1 else "latin-1", "replace").split("\0")
                out["tags"][parts[0] if name == "TXXX" else name] = parts[-1]
            p += 10 + n
        at = stop
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out["tags"].setdefault("TIT2", data[end - 125 : end - 95].split(b"\0")[0].decode("latin-1").strip())
        end -= 128
    good: dict[bytes, bool] = {}
    known: dict[bytes, tuple | None] = {}

    def header(p: int):
        k = data[p : p + 4]
        if k not in known:
            known[k] = _frame(k, 0)
        return known[k]

    sure = False  # the frame before ended here
    while at < end:
        f = header(at) if at + 4 <= end else None
        after = at + f[0] if f else 0
        if f and after <= end and (after == end or header(after) or (sure and after + 4 > end)):
            length, samples, hertz, kbit, version, checked = f
            side = (17 if data[at + 3] >> 6 == 3 else 32) if version == 3 else (9 if data[at + 3] >> 6 == 3 else 17)
            start = at + 4 + 2 * checked
            if checked and data[at + 1] >> 1 & 3 == 1:
                key = data[at + 2 : start + side]
                if key not in good:
                    good[key] = frame_crc(key[:2] + key[4:]) == struct.unpack(">H", key[2:4])[0]
                out["checked"] += 1
                out["bad_checks"] += not good[key]
            body = start + side
            if not out["frames"] and out["table"] is None and data[body : body + 4] in (b"Xing", b"Info"):
                flags, p, t = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8, {"kind": data[body : body + 4].decode(), "offset": at}
                for bit, key in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        t[key] = struct.unpack(">I", data[p : p + 4])[0]
                        p += 4
                if flags & 4:
                    t["points"] = list(data[p : p + 100])
                    p += 100
                p += 4 * bool(flags & 8)
                if p + 36 <= after:
                    t["music_crc"], t["info_crc"] = struct.unpack(">HH", data[p + 32 : p + 36])
                    t["info_ok"] = tag_crc(data[at : p + 34]) == t["info_crc"]
                    t["music_ok"] = tag_crc(data[after:end]) == t["music_crc"]
                out["table"] = t
            elif not out["frames"] and out["table"] is None and data[at + 36 : at + 40] == b"VBRI":
                size, count, entries, scale, width = *struct.unpack(">II", data[at + 46 : at + 54]), *struct.unpack(">HHH", data[at + 54 : at + 60])
                raw = data[at + 62 : at + 62 + entries * width]
                out["table"] = {"kind": "VBRI", "offset": at, "bytes": size, "frames": count, "points": [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw), width or 1)]}
            else:
                out["frames"].append((at, length, body - at))
                out["samples"] += samples
                out["hertz"] = out["hertz"] or hertz
                out["seconds"] += samples / hertz
                out["rates"][kbit] = out["rates"].get(kbit, 0) + 1
            at, sure = after, True
            continue
        sure = False
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out["damage"] += nxt - at
        at = nxt
    return out


def decode(data: bytes, found: dict | None = None) -> bytes:
    """The payload that encode() put in."""
    found = found or parse(data)
    joined = b"".join(data[at + lead : at + length] for at, length, lead in found["frames"])
    return joined[: int(found["tags"].get("PAYLOAD", len(joined)))]


def features_of(data: bytes, found: dict) -> str:
    """Durations, tables and seek offsets as one string."""
    t = found["table"] or {}
    offsets = np.array([f[0] for f in found["frames"]], "<u8")
    rates = ",".join(f"{k}:{v}" for k, v in sorted(found["rates"].items()))
    points = [int(offsets[k * len(offsets) // 10]) for k in range(10)] if len(offsets) else []
    return (
        f"frames={len(offsets)};samples={found['samples']};seconds={found['seconds']:.6f};kbit={rates};vbr={t.get('kind', '')};table_frames={t.get('frames', 0)};"
        f"table_bytes={t.get('bytes', 0)};info_ok={int(t.get('info_ok', False))};music_ok={int(t.get('music_ok', False))};checked={found['checked']};bad={found['bad_checks']};"
        f"damage={found['damage']};offsets_crc={zlib.crc32(offsets.tobytes())};seek={','.join(map(str, points))}"
    )


def store(text: str | None) -> dict:
    """One text as a stored file and what reading it back gives."""
    raw = (text or "").encode("utf-8", "replace")
    media = encode(payload_of(raw))
    found = parse(media)
    back = decode(media, found)
    return {"raw": raw, "media": media, "back": back, "found": found}


_COLUMNS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "n_frames": pa.int64(), "n_samples": pa.int64(), "sample_rate": pa.int64(), "duration_us": pa.int64(), "frame_offsets": pa.list_(pa.int64()), "media": pa.binary(),
}


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """doc_id, what was stored and read back (n_bytes to feature), n_frames, the exact duration as n_samples at sample_rate a second
    (duration_us rounds it), frame_offsets (where each audio frame begins), and the file itself if asked for."""

    def make():
        def work(texts: list) -> dict:
            rows = []
            for text in texts:
                s = store(text)
                back, media, found = s["back"], s["media"], s["found"]
                rows.append((
                    len(s["raw"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features_of(media, found),
                    len(found["frames"]), found["samples"], found["hertz"], round(found["seconds"] * 1e6), [f[0] for f in found["frames"]], media if with_media else None,
                ))
            return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(_COLUMNS.items())}

        return work

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    out = map_texts(docs, make, ", ".join(f"{n} {kinds[k]}" for n, k in _COLUMNS.items()))
    return out if with_media else out.drop("media")
