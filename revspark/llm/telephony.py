"""Telephony audio: mu-law, A-law and ADPCM in WAV form, expanded and resampled to PCM.

Companded codes are expanded by look-up tables. ADPCM is a recursion within a block but blocks
are independent, so that all blocks of a batch are decoded together, one sample of each at a time.
All arithmetic is on integers: results don't depend on the machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .textvec import slices

UNIT = 192  # bytes of codes in an ADPCM block, and what payloads are padded to a multiple of
RATE = 8000
#: Format tags of WAV files.
ADPCM, ALAW, MULAW = 0x11, 6, 7
NAMES = {ADPCM: "adpcm", ALAW: "alaw", MULAW: "mulaw"}
_BLOCK_HEADER = 4
_CHUNK_BLOCKS = 4096


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, low, (low + 256) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}

# Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])

_code = np.arange(16)
_DIFF = ((STEPS[:, None] >> 3) + np.where(_code & 4, STEPS[:, None], 0) + np.where(_code & 2, STEPS[:, None] >> 1, 0) + np.where(_code & 1, STEPS[:, None] >> 2, 0)) * np.where(_code & 8, -1, 1)
_DIFF = _DIFF.astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + INDEX_CHANGE[_code & 7], 0, 88) * 16).astype(np.int32).ravel()  # times 16: the row's start


def expand_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, one per row: a header of 4 bytes, then codes, low half of a byte first."""
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - _BLOCK_HEADER)), np.int16)
    for at in range(0, n, _CHUNK_BLOCKS):
        part = blocks[at : at + _CHUNK_BLOCKS]
        value = part[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        row = np.minimum(part[:, 2], 88).astype(np.int32) * 16
        codes = np.ascontiguousarray(part[:, _BLOCK_HEADER:].T).astype(np.int32)
        got = np.empty((out.shape[1], len(part)), np.int16)
        got[0] = value
        for k in range(2 * len(codes)):
            cell = row + (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15)
            value = np.minimum(np.maximum(value + _DIFF[cell], -32768), 32767)
            row = _NEXT[cell]
            got[k + 1] = value
        out[at : at + _CHUNK_BLOCKS] = got.T
    return out


def pick(payload: bytes) -> int:
    """The format that a payload is stored in, by its content alone."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def wav(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file of the codes in `payload`, whose length is a multiple of UNIT."""
    if tag == ADPCM:
        body = np.zeros((len(payload) // UNIT, _BLOCK_HEADER + UNIT), np.uint8)
        body[:, _BLOCK_HEADER:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits = body.tobytes(), _BLOCK_HEADER + UNIT, 4
        per_block = 1 + 2 * UNIT
        extra, samples = struct.pack("<HH", 2, per_block), len(body) * per_block
        speed = rate * align // per_block
    else:
        data, align, bits, extra, samples, speed = payload, 1, 8, struct.pack("<H", 0), len(payload), rate
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    parts = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)]
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse(media: bytes) -> tuple[int, int, int, np.ndarray]:
    """Format tag, rate, block size and data of a WAV file; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, align, data = 12, 0, 0, 1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    if data is None or tag not in NAMES:
        raise ValueError("no telephony audio in this file")
    return tag, rate, align, data


def codes(tag: int, align: int, data: np.ndarray) -> bytes:
    """The payload: all codes without block headers."""
    return data.reshape(-1, align)[:, _BLOCK_HEADER:].tobytes() if tag == ADPCM else data.tobytes()


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples per second: between two samples goes the cubic through the four nearest, (-1, 9, 9, -1) / 16."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if not len(pcm):
        return out
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    n = len(pcm)
    out[1::2] = np.clip((9 * (x[1 : n + 1] + x[2 : n + 2]) - x[:n] - x[3 : n + 3] + 8) >> 4, -32768, 32767)
    return out


def summary(codec: str, rate: int, pcm: np.ndarray) -> str:
    """Number of samples, peak, energy, zero crossings and checksum of resampled PCM, as text."""
    wide = pcm.astype(np.int32)
    peak = int(np.abs(wide).max()) if len(wide) else 0
    power = int(np.dot(wide.astype(np.int64), wide.astype(np.int64))) // max(len(wide), 1)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"codec={codec};rate={rate};samples={len(pcm)};peak={peak};power={power};crossings={crossings};crc={zlib.crc32(pcm.tobytes()):08x}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces, as the codes of a WAV file.

    One row per row of docs, repeated ids included; a null text is empty, and an empty one is a block of spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 22):
                sizes, out = [], []
                for text in b.column(1).cast(pa.large_binary()):
                    raw = text.as_py() or b""
                    payload = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)
                    sizes.append(len(raw))
                    out.append(wav(payload, pick(payload)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, media binary")


def decode(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm): what the stored bytes hold.

    pcm: the expanded samples at twice the rate, 16 bits each, little-endian; feature: a summary of them.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "media", 1 << 21):
                stored = [m.as_py() for m in b.column(2)]
                files = [parse(m) for m in stored]
                packed = [data.reshape(-1, align) for tag, _, align, data in files if tag == ADPCM]
                widths = {p.shape[1] for p in packed}
                blocks = {w: expand_adpcm(np.concatenate([p for p in packed if p.shape[1] == w])) for w in widths}
                used = dict.fromkeys(widths, 0)
                rows: list[list] = [[] for _ in names[2:]]
                for m, (tag, rate, align, data) in zip(stored, files):
                    payload = codes(tag, align, data)
                    if tag == ADPCM:
                        n = len(data) // align
                        pcm = blocks[align][used[align] : used[align] + n].ravel()
                        used[align] += n
                    else:
                        pcm = EXPAND[tag][data]
                    pcm = double_rate(pcm).astype("<i2", copy=False)
                    values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), summary(NAMES[tag], 2 * rate, pcm), pcm.tobytes()]
                    for c, v in zip(rows, values):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(rows, kinds[2:]))], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm binary"
    return mapped(media.select("doc_id", "n_bytes", "media"), run, schema)


def total_seconds(decoded: DataFrame, rate: int = 2 * RATE) -> DataFrame:
    """One row: the number of files and their length in seconds."""
    samples = F.regexp_extract("feature", "samples=([0-9]+)", 1).cast("long")
    return decoded.agg(F.count("*").alias("files"), (F.sum(samples) / rate).alias("seconds"))
