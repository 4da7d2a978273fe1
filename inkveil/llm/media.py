"""Telephony audio columns: G.711 and IMA ADPCM samples, their expansion to PCM, and resampling.

Edge cases, for every entry point: null text counts as empty; an empty payload is padded to one frame; equal
payloads give equal results; rows keep their multiplicity; an empty table gives an empty table; further input
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, table

FRAME = 192
RATE = 8000
#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}

# Fixed values of IMA ADPCM: quantiser steps, and the change of the step index by nibble.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
#: By step index and nibble: the change of the predictor.
ADPCM_DELTA = np.array(
    [[(-1 if n & 8 else 1) * ((s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1)) for n in range(16)] for s in STEPS.tolist()], dtype=np.int32
).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """uint8 (n, width) blocks of mono IMA ADPCM to int16 (n, 1 + 2 * (width - 4)) samples.

    The loop runs over nibbles; each step decodes that nibble of all blocks at once.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    predictor = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = predictor
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for j in range(width - 4):
        for k, nibble in ((1, columns[j] & 15), (2, columns[j] >> 4)):
            predictor += ADPCM_DELTA[index * 16 + nibble]
            np.clip(predictor, -32768, 32767, out=predictor)
            index += INDEX_STEP[nibble]
            np.clip(index, 0, 88, out=index)
            out[2 * j + k] = predictor
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation of int16 samples from one rate to another; no samples give none."""
    if len(pcm) == 0 or source == target:
        return pcm
    n = len(pcm) * target // source
    at = np.arange(n, dtype=np.int64) * source
    left = at // target
    right = np.minimum(left + 1, len(pcm) - 1)
    part = at - left * target
    x = pcm.astype(np.int64)
    return ((x[left] * (target - part) + x[right] * part) // target).astype(np.int16)


def payload(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of FRAME."""
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME))


def store(samples: bytes, codec: str = "mulaw") -> bytes:
    """A mono WAVE file that holds samples unchanged."""
    align, bits = (FRAME, 4) if codec == "ima_adpcm" else (1, 8)
    per_block = 1 + 2 * (FRAME - 4)
    extra = struct.pack("<H", per_block) if codec == "ima_adpcm" else b""
    per_second = RATE * align // per_block if codec == "ima_adpcm" else RATE
    head = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, per_second, align, bits, len(extra)) + extra
    count = len(samples) // align * (per_block if codec == "ima_adpcm" else 1)
    body = b"".join(
        tag + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for tag, x in ((b"fmt ", head), (b"fact", struct.pack("<I", count)), (b"data", samples))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def load(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and samples of a file that store() made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, parts = 12, {}
    while at + 8 <= len(media):
        tag, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        parts[tag] = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    tag, _, rate = struct.unpack_from("<HHI", parts[b"fmt "])
    return {v: k for k, v in TAGS.items()}[tag], rate, parts[b"data"]


def expand(codec: str, samples: bytes) -> np.ndarray:
    raw = np.frombuffer(samples, dtype=np.uint8)
    if codec == "ima_adpcm":
        return decode_adpcm(raw[: len(raw) // FRAME * FRAME].reshape(-1, FRAME)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


#: Bytes of files, payloads and PCM that wait for a batch; a longer text is a batch of its own.
FLUSH = 8_000_000

SCHEMA = "id bigint, n_bytes bigint, media binary, payload binary, pcm binary, feature string"


def _level(x: np.ndarray) -> str:
    y = x.astype(np.int64)
    return f"{int(np.sqrt((y @ y) / len(y)))},{int(np.abs(y).max())},{int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))}"


def _records(column: pa.Array, target_rate: int):
    """For each text: unpadded bytes, stored file, payload read back, resampled PCM, features."""
    for _, _, texts in slices(column):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        files = [store(payload(x)) for x in data]
        read = [load(f) for f in files]
        blocks = np.concatenate([np.frombuffer(s, dtype=np.uint8) for _, _, s in read]).reshape(-1, FRAME)
        adpcm = decode_adpcm(blocks)
        at = 0
        for x, f, (codec, rate, s) in zip(data, files, read, strict=True):
            pcm = expand(codec, s)
            other = expand("alaw", s)
            n = len(s) // FRAME
            ima = adpcm[at : at + n]
            at += n
            wide = resample(pcm, rate, target_rate).astype("<i2").tobytes()
            feature = f"mulaw {_level(pcm)};alaw {_level(other)};adpcm {int(np.abs(ima.astype(np.int32)).mean())},{zlib.crc32(np.ascontiguousarray(ima)):08x};pcm{target_rate} {len(wide) // 2},{zlib.crc32(wide):08x}"
            yield len(x), f, s, wide, feature


def audio(docs: DataFrame, key: str = "doc_id", text: str = "text", target_rate: int = 16000) -> DataFrame:
    """Per row: the stored mu-law file, the payload read back from it, PCM at target_rate, and features.

    feature: root mean square, peak and sign changes of the mu-law and of the A-law expansion; mean magnitude and
    crc32 of the same bytes decoded as IMA ADPCM blocks; length and crc32 of the resampled PCM.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            at = size = 0
            out: list = []
            for row in _records(batch.column(1), target_rate):
                out.append(row)
                size += sum(map(len, row[1:4]))
                if size > FLUSH:
                    yield _batch(ids.slice(at, len(out)), out)
                    at, size, out = at + len(out), 0, []
            if out:
                yield _batch(ids.slice(at, len(out)), out)
        release()

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(ids: pa.Array, rows: list) -> pa.RecordBatch:
    n, media, read, pcm, feature = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(read, pa.binary()), pa.array(pcm, pa.binary()), pa.array(feature, pa.string())], names=["id", "n_bytes", "media", "payload", "pcm", "feature"])


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audio(table(spark, sf_dir, "documents"))
    return a.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substr(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
        "feature",
    )


def brute(text: str | None) -> dict:
    """The query's fixed columns for one text, without NumPy or Spark."""
    data = (text or "").encode()
    p = data
    while len(p) % FRAME or not p:
        p += b" "
    return {"n_bytes": len(data), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:])}
