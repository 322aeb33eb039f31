import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from quern.llm.media import FRAME, HOP, fingerprint, media_features, peaks


def test_columns_follow_from_the_stored_wav(odd):
    got = media_features(odd).collect()
    assert len(got) == 9
    for r, d in zip(sorted(got, key=lambda x: (x["doc_id"] or 0, x["n_bytes"])), sorted(odd.collect(), key=lambda x: (x["doc_id"] or 0, len(x["text"] or ""))), strict=True):
        raw = (d["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1) and w.readframes(w.getnframes()) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(r["media"]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert len(r["times"]) == len(r["codes"]) and r["times"] == sorted(r["times"])


def test_equal_texts_have_equal_values(make):
    text = "some words again and again " * 40
    got = media_features(make((1, text), (2, "x" * 999), (3, text)), outputs=()).collect()
    by = {r["doc_id"]: r["feature"] for r in got}
    assert by[1] == by[3] != by[2]
    assert media_features(make((1, "a")).where("false")).count() == 0


def test_a_tone_peaks_at_its_frequency():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * 30 * t / FRAME)).astype(np.uint8).tobytes()
    top = peaks(tone)
    assert len(top) == (8192 - FRAME) // HOP + 1 and (top[:, 1] == 30).all()
    times, codes = fingerprint(tone)
    assert (30 << 16 | 30 << 8 | 1) in codes[times == 0].tolist()


def test_every_part_of_a_text_reaches_the_feature(make):
    long = "".join(chr(97 + i * i % 26) for i in range(640))
    texts = ["a", "another short text", "x" * 380, "xy" * 190, *(long[:n] + c * 40 for n in (472, 536, 600) for c in "az")]
    got = media_features(make(*enumerate(texts)), outputs=()).collect()
    assert len({r["feature"] for r in got}) == len(texts)
    assert all(int(r["feature"].split(":")[1]) > 0 for r in got)


def test_first_and_last_samples_count():
    for size in (64, 256, 320, 384, 448, 640):
        for part in (slice(0, 16), slice(size - 16, size)):
            payload = bytearray(b"\x80" * size)
            payload[part] = bytes((255, 255, 0, 0) * 4)
            assert fingerprint(bytes(payload))[1].tolist() != fingerprint(b"\x80" * size)[1].tolist()


def test_all_bands_are_paired():
    payload = bytes(i * i % 251 for i in range(4096))
    lap = FRAME - HOP
    top = peaks(b"\x80" * lap + payload)
    times, codes = fingerprint(payload)
    for gap in (1, 2, 3):
        want = {int(a) << 16 | int(b) << 8 | gap for a in top[4] for b in top[4 + gap]}
        assert want == {c for c in codes[times == 4].tolist() if c & 255 == gap} and len(want) == 16


@pytest.mark.parametrize("size", [64, 320, 704])
def test_feature_equals_sums_of_cosines(make, size):
    """Every column again from the definition: transform by sums, peaks, pairs, digest."""
    text = "".join(chr(33 + i * i * 7 % 90) for i in range(size - 5))
    payload = text.encode() + bytes(5)
    lap, hops = FRAME - HOP, 1
    while lap + size + lap > FRAME + hops * HOP:
        hops += 1
    samples = [0.0] * lap + [b - 128.0 for b in payload]
    samples += [0.0] * (FRAME + hops * HOP - len(samples))
    top = []
    n = np.arange(FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / (FRAME - 1))
    for frame in range(hops + 1):
        part = np.array(samples[frame * HOP : frame * HOP + FRAME]) * window
        power = [float((part * np.cos(2 * np.pi * k * n / FRAME)).sum() ** 2 + (part * np.sin(2 * np.pi * k * n / FRAME)).sum() ** 2) for k in range(129)]
        top.append([max(range(low, high), key=power.__getitem__) for low, high in ((1, 16), (16, 40), (40, 80), (80, 129))])
    pairs = [(i, a << 16 | b << 8 | gap) for i in range(len(top)) for gap in (1, 2, 3) if i + gap < len(top) for a in top[i] for b in top[i + gap]]
    times, codes = (np.array(x, "<i4") for x in zip(*pairs, strict=True))
    (got,) = media_features(make((1, text))).collect()
    assert got["times"] == times.tolist() and got["codes"] == codes.tolist()
    assert got["feature"] == f"stft{FRAME}:{len(pairs)}:{hashlib.blake2b(times.tobytes() + codes.tobytes(), digest_size=16).hexdigest()}"


def test_clashing_columns(make):
    docs = make((1, "a")).selectExpr("*", "1 AS times", "2 AS codes", "3 AS media", "4 AS n_bytes")
    assert media_features(docs).first()["n_bytes"] == 1
