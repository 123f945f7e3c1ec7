"""Telephony audio columns: G.711 mu-law and A-law, and block ADPCM.

A document's payload becomes a RIFF/WAVE file of one of three telephone codecs;
decoding expands mu-law and A-law by lookup tables and ADPCM with numpy across
all blocks of a batch at once, one step per sample position, and the decoded
8 kHz signal is resampled to 16 kHz PCM.

Payload: the text's UTF-8 bytes, followed by bytes 255 up to a positive multiple
of 576.  The codec follows the text's CRC-32, so equal texts have equal files.

Defined results: a null or empty text is a payload of 576 bytes 255; repeated
rows give equal values; an empty table gives an empty table; further columns are
ignored.
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

from .common import id_text, slices

UNIT = 576
RATE = 8000
#: Bytes of an ADPCM block: a head of four and two samples in each further byte.
ADPCM_BLOCK = 64
#: WAVE format tags of the codecs.
MU_LAW, A_LAW, ADPCM = 7, 6, 17
CODECS = {MU_LAW: "mulaw", A_LAW: "alaw", ADPCM: "adpcm"}

# Fixed values of the ADPCM standard: step index changes for the code's magnitude.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Fixed values of the ADPCM standard: the 89 step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent = code >> 4 & 7
    value = ((code & 15) << 4) + 8
    value = np.where(exponent, value + 256 << np.maximum(exponent - 1, 0), value)
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) of 16-bit PCM from (blocks, bytes): all blocks step together."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = value
    for i, pair in enumerate(body):
        for j, code in enumerate((pair & 15, pair >> 4)):
            step = STEPS[index]
            size = code & 7
            change = (2 * size.astype(np.int32) + 1) * step >> 3
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[size], 0, len(STEPS) - 1)
            out[1 + 2 * i + j] = value
    return np.ascontiguousarray(out.T)


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, and after each the mean of it and the next."""
    wide = samples.astype(np.int32)
    out = np.empty(2 * len(wide), "<i2")
    out[::2] = wide
    out[1:-1:2] = wide[:-1] + wide[1:] >> 1
    out[-1:] = wide[-1:]
    return out


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def write_wave(codec: int, body: bytes) -> bytes:
    """A RIFF file of one channel at 8 kHz with ``body`` as its coded samples."""
    if codec == ADPCM:
        per_block = 2 * (ADPCM_BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * ADPCM_BLOCK // per_block, ADPCM_BLOCK, 4, 2, per_block)
        count = len(body) // ADPCM_BLOCK * per_block
    else:
        form = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
        count = len(body)
    parts = b"".join(struct.pack("<4sI", name, len(part)) + part for name, part in ((b"fmt ", form), (b"fact", struct.pack("<I", count)), (b"data", body)))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(parts), b"WAVE") + parts


def read_wave(media: bytes) -> tuple[int, bytes]:
    """(codec, coded samples) of a RIFF file."""
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or wave != b"WAVE" or size + 8 != len(media):
        raise ValueError("not a whole RIFF/WAVE file")
    at, codec = 12, 0
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            codec = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def codec_of(text: bytes) -> int:
    return (MU_LAW, A_LAW, ADPCM)[zlib.crc32(text) % 3]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        media = [write_wave(codec_of(t), payload(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WAVE file of every document.

    The rows are written by whoever keeps them; ``decode_audio`` reads them back.
    """
    return id_text(docs).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def decode(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16 kHz PCM of coded signals; the blocks of all ADPCM ones step together."""
    out: list[np.ndarray | None] = [None] * len(files)
    coded = [i for i, (codec, _) in enumerate(files) if codec == ADPCM]
    if coded:
        samples = decode_adpcm(np.frombuffer(b"".join(files[i][1] for i in coded), np.uint8).reshape(-1, ADPCM_BLOCK))
        at = 0
        for i in coded:
            n = len(files[i][1]) // ADPCM_BLOCK
            out[i] = resample(samples[at : at + n].ravel())
            at += n
    for i, (codec, body) in enumerate(files):
        if codec in TABLES:
            out[i] = resample(TABLES[codec][np.frombuffer(body, np.uint8)])
    return out


def features(codec: int, pcm: np.ndarray) -> str:
    """Codec, samples, root mean square, peak, zero crossings and the PCM's CRC-32."""
    wide = pcm.astype(np.int64)
    rms = float(np.sqrt(np.dot(wide, wide) / len(wide)))
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm))))
    return f"codec={CODECS[codec]} rate={2 * RATE} samples={len(pcm)} rms={rms:.3f} peak={int(np.abs(wide).max())} crossings={crossings} pcm_crc32={zlib.crc32(pcm.tobytes()):08x}"


def _decoded(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            media = batch.column("media").to_pylist()
            files = [read_wave(m) for m in media]
            pcm = decode(files)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array([len(b) for _, b in files], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for _, b in files]),
                "tail_crc32": pa.array([zlib.crc32(b[-32:]) for _, b in files], pa.int64()),
                "media_bytes": pa.array(list(map(len, media)), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                "feature": pa.array([features(c, p) for (c, _), p in zip(files, pcm)]),
            }
            if keep_pcm:
                columns["pcm"] = pa.array([p.tobytes() for p in pcm], pa.binary())
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))

    return run


def decode_audio(media: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Read stored files back: payload checks, features and, if asked, the 16 kHz PCM."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoded(keep_pcm), out + (", pcm binary" if keep_pcm else ""))
