"""Media columns: telephony audio (mu-law, A-law, IMA ADPCM) in WAV containers.

Bytes of a column become 8-bit companded samples in a RIFF/WAVE file (format tag
7 for mu-law, 6 for A-law), which is lossless, as each sample is one byte. Reading
parses the container again. Companded samples are expanded to 16-bit PCM by
lookup tables; ADPCM blocks (format tag 17) are decoded step by step with numpy
across all blocks at once, a block's steps being the only sequential part; PCM
is resampled by linear interpolation and stored as a format-1 WAV.

Work on one text goes through fixed windows of CHUNK bytes, so memory beyond
the text's own bytes doesn't grow with it.

Defined cases: a null or empty text is one block of padding; equal texts give
equal values; rows with a null id are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Payloads are padded with byte 255 to a positive multiple of this.
BLOCK = 576
#: Bytes of an ADPCM block: a header of four and thirty-two with two samples each.
ADPCM_BLOCK = 36
CHUNK = ADPCM_BLOCK * 16384
RATE = 8000
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}

# The IMA ADPCM step table and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def _nibble_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: the change of the sample and the next step index."""
    index, nibble = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    diff = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -diff, diff).astype(np.int32), (np.clip(index + INDEX_CHANGE[nibble], 0, 88) * 16).astype(np.int32)


_CHANGE, _NEXT = _nibble_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, bytes of a block) to (n, samples) of 16-bit PCM; low nibble first.

    The header has the first sample (little-endian) and the step index, of which
    values over the last are read as the last.
    """
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = sample
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size - 4):
        byte = data[k]
        for j, nibble in enumerate((byte & 15, byte >> 4)):
            at = index + nibble
            sample += _CHANGE[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = _NEXT[at]
            out[1 + 2 * k + j] = sample
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; the last sample is held."""
    n = len(pcm) * to // rate
    if not n:
        return np.zeros(0, np.int16)
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    return np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm).astype(np.int16)


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def write_wav(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file with one channel of the codec's samples or blocks."""
    align = {"pcm": 2, "adpcm": ADPCM_BLOCK}.get(codec, 1)
    per_second = rate * align if codec != "adpcm" else rate * align // (1 + 2 * (align - 4))
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, per_second, align, bits)
    if codec == "adpcm":
        fmt += struct.pack("<HH", 2, 1 + 2 * (align - 4))
    elif codec != "pcm":
        fmt += struct.pack("<H", 0)
    head = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if codec != "pcm":
        head += b"fact" + struct.pack("<II", 4, len(data) // align * (1 if codec != "adpcm" else 1 + 2 * (align - 4)))
    tail = b"\0" * (len(data) % 2)
    body = b"WAVE" + head + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(body) + len(data) + len(tail)) + body + data + tail


@dataclass(frozen=True)
class Wav:
    codec: str
    rate: int
    align: int
    data: memoryview


def read_wav(file: bytes) -> Wav:
    """Parse what write_wav (or another writer of one channel) has stored."""
    view = memoryview(file)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if fmt is None:
                break
            codec = next(k for k, v in FORMATS.items() if v == fmt[0])
            return Wav(codec, fmt[2], fmt[4], view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no fmt or data chunk")


def to_pcm(wav: Wav) -> np.ndarray:
    """16-bit PCM of a whole file."""
    raw = np.frombuffer(wav.data, np.uint8)
    if wav.codec == "pcm":
        return raw.view("<i2")
    if wav.codec == "adpcm":
        return decode_adpcm(raw[: len(raw) // wav.align * wav.align].reshape(-1, wav.align)).reshape(-1)
    return (MULAW if wav.codec == "mulaw" else ALAW)[raw]


def features(payload: memoryview | bytes) -> str:
    """Figures of the bytes as mu-law, A-law and ADPCM sound, in text.

    For each codec the sum of squares and the sign changes of its PCM; for
    mu-law also the CRC-32 of the PCM resampled to twice the rate.
    """
    raw = np.frombuffer(payload, np.uint8)
    counts = np.bincount(raw, minlength=256)
    squares = {name: int(counts @ (table.astype(np.int64) ** 2)) for name, table in (("mulaw", MULAW), ("alaw", ALAW))}
    power, changes, resampled = 0, {"mulaw": 0, "alaw": 0, "adpcm": 0}, 0
    for k in range(0, len(raw), CHUNK):
        part = raw[k : k + CHUNK]
        # A sample's sign is its top bit in both laws, but for mu-law's two zeros, which count by that bit too.
        sign = part >> 7
        flips = int(np.count_nonzero(sign[1:] != sign[:-1])) + (k > 0 and int((raw[k - 1] >> 7) != sign[0]))
        changes["mulaw"] += flips
        changes["alaw"] += flips
        blocks = decode_adpcm(part.reshape(-1, ADPCM_BLOCK))
        power += int(np.einsum("ij,ij->", blocks, blocks, dtype=np.int64))
        changes["adpcm"] += int(np.count_nonzero((blocks[:, 1:] < 0) != (blocks[:, :-1] < 0)))
        # With the next chunk's first sample, which the last one is drawn towards.
        resampled = zlib.crc32(resample(MULAW[raw[k : k + CHUNK + 1]], RATE, 2 * RATE)[: 2 * len(part)].tobytes(), resampled)
    return f"mulaw:{squares['mulaw']}:{changes['mulaw']};alaw:{squares['alaw']}:{changes['alaw']};adpcm:{power}:{changes['adpcm']};pcm16k:{resampled:08x}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "mulaw", pcm_rate: int = 2 * RATE) -> DataFrame:
    """(id, media binary, pcm binary): the text's bytes as a companded WAV, and its sound resampled in a PCM WAV."""
    from treelake.llm._arrow import col, map_texts

    if codec not in ("mulaw", "alaw"):
        raise ValueError("only 8-bit codecs keep any bytes")
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def start():
        def run(ids, texts):
            media = [write_wav(pad((t or "").encode()), codec) for t in texts]
            pcm = [write_wav(resample(to_pcm(w := read_wav(m)), w.rate, pcm_rate).tobytes(), "pcm", pcm_rate) for m in media]
            yield {"i": ids, "media": media, "pcm": pcm}

        return run

    return map_texts(df, id_col, text_col, f"i {kind}, media binary, pcm binary", start, limit=1 << 20).selectExpr(f"i as `{id_col}`", "media", "pcm")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests and features of what is stored and read back, without carrying the files out."""
    from treelake.llm._arrow import col, map_texts

    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    names = "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"

    def one(text: str | None):
        data = (text or "").encode()
        media = write_wav(pad(data), "mulaw")
        back = read_wav(media).data
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back)

    def start():
        def run(ids, texts):
            yield {"i": ids} | dict(zip(names, zip(*map(one, texts))))

        return run

    schema = f"i {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(df, id_col, text_col, schema, start).selectExpr(f"i as `{id_col}`", *names)
