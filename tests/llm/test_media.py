import hashlib
import zlib

import numpy as np

from inkveil.llm import media

TEXTS = [None, "", "a", "é" * 96, "x" * 192, "long text " * 30_000, "a", "<\0>\n"]


def test_query_matches_brute_force(spark, docs_dir):
    path = docs_dir([(i, t, None, None, None) for i, t in enumerate(TEXTS)])
    rows = {r.doc_id: r for r in media.op5_telephony_audio(spark, path).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert {k: rows[i][k] for k in media.brute(t)} == media.brute(t)
    assert rows[2][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    stored = media.store(media.payload(TEXTS[3].encode()))
    assert rows[3].media_sha256 == hashlib.sha256(stored).hexdigest() and rows[3].media_bytes == len(stored)
    assert media.op5_telephony_audio(spark, docs_dir([])).count() == 0


def test_tables_and_round_trip():
    assert (media.MULAW[0], media.MULAW[0x80], media.MULAW[0xFF]) == (-32124, 32124, 0)
    assert (media.ALAW[0xD5], media.ALAW[0x55], media.ALAW[0xAA], media.ALAW[0x2A]) == (8, -8, 32256, -32256)
    for codec in media.TAGS:
        data = bytes(range(192)) * 3
        assert media.load(media.store(data, codec)) == (codec, 8000, data)


def _one_block(block):
    predictor = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [predictor]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = step >> 3
            d += step if n & 4 else 0
            d += step >> 1 if n & 2 else 0
            d += step >> 2 if n & 1 else 0
            predictor = max(-32768, min(32767, predictor - d if n & 8 else predictor + d))
            index = max(0, min(88, index + int(media.INDEX_STEP[n])))
            out.append(predictor)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (17, 192), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [_one_block(b.tobytes()) for b in blocks]
    assert media.decode_adpcm(blocks[:0]).shape == (0, 377)


def test_resample():
    x = np.array([0, 100, -100], dtype=np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(x, 16000, 8000).tolist() == [0]
    assert len(media.resample(x[:0], 8000, 16000)) == 0


def test_features_and_pcm_match_brute_force(spark, docs_dir, monkeypatch):
    monkeypatch.setattr(media, "FLUSH", 3_000)  # batches of a few rows, and of one
    path = docs_dir([(i, t, None, None, None) for i, t in enumerate(TEXTS)])
    rows = {r.doc_id: r for r in media.op5_telephony_audio(spark, path).collect()}
    for i, t in enumerate(TEXTS):
        if len(t or "") > 10_000:
            continue
        data = (t or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)

        def level(x):
            changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
            return f"{int((sum(v * v for v in x) / len(x)) ** 0.5)},{max(map(abs, x))},{changes}"

        mulaw, alaw = ([int(table[b]) for b in data] for table in (media.MULAW, media.ALAW))
        ima = [v for at in range(0, len(data), 192) for v in _one_block(data[at : at + 192])]
        wide = media.resample(np.array(mulaw, dtype=np.int16), 8000, 16000).astype("<i2").tobytes()
        crc = zlib.crc32(np.array(ima, dtype="<i2").tobytes())
        assert rows[i].feature == f"mulaw {level(mulaw)};alaw {level(alaw)};adpcm {int(sum(map(abs, ima)) / len(ima))},{crc:08x};pcm16000 {len(wide) // 2},{zlib.crc32(wide):08x}"
        assert rows[i].pcm_sha256 == hashlib.sha256(wide).hexdigest() and len(wide) == 4 * len(data)
