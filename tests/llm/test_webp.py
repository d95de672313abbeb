"""op1: exact round trips of the format and of texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import webp, webp_many


@given(st.binary(min_size=1, max_size=4000))
@settings(max_examples=40, deadline=None)
def test_payloads_come_back(data):
    payload = data + b"\0" * (-len(data) % 64)
    assert b"".join(x.tobytes() for x in webp.images(webp.to_media(payload))) == payload


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("options", [
    {}, {"transforms": (2,)}, {"transforms": (0,)}, {"transforms": (1,)}, {"transforms": (2, 0, 1)}, {"transforms": (0, 2)}, {"cache_bits": 4},
    {"references": True}, {"cache_bits": 6, "references": True}, {"regions": 2}, {"transforms": (0, 1, 2), "cache_bits": 3, "references": True, "regions": 3},
])
def test_every_transform_and_coding(options, seed):
    rnd = np.random.default_rng(seed)
    shape = [(1, 1), (7, 5), (19, 33), (40, 21)][seed]
    image = (rnd.integers(0, 256, (*shape, 4)) if seed % 2 else np.add.outer(np.add.outer(np.arange(shape[0]), np.arange(shape[1])), [0, 3, 9, 200]) % 256).astype(np.uint8)
    assert np.array_equal(webp.decode(webp.encode_with(image, **options)), image)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    rnd = np.random.default_rng(colours)
    table = rnd.integers(0, 256, (colours, 4)).astype(np.uint8)
    image = table[rnd.integers(0, colours, (13, 29))]
    for extra in ({}, {"cache_bits": 2, "references": True}):
        assert np.array_equal(webp.decode(webp.encode_with(image, transforms=(3,), **extra)), image)


def test_damaged_files_raise():
    good = webp.to_media(b"abcd" * 64)
    for bad in (b"", b"RIFF", good[:11], b"XXXX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_query_columns(spark):
    rnd = random.Random(1)
    texts = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "né ☃ \U0001f600", "\0", "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(5000)), "lorem ipsum " * 200_000]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(2**60 + 1, "a")]
    got = {(r.doc_id, r.n_bytes): r for r in webp.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        r = got[(i, len(data))]
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = webp.to_media(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[(2, 1)].feature == got[(2**60 + 1, 1)].feature


def stored_steps(monkeypatch, payload):
    """What the plain reader comes upon in the files of a payload: transforms, predictors, cross-colour factors, kinds of tokens."""
    found = {"predictors": set(), "factors": set(), "tokens": set()}
    predict, cross, symbol = webp.predict, webp.cross, webp.Reader.symbol

    def seen_predict(image, tiles, bits, forward):
        found["predictors"] |= set(tiles[..., 1].ravel().tolist())
        return predict(image, tiles, bits, forward)

    def seen_cross(image, tiles, bits, forward):
        found["factors"] |= set(tiles[..., :3].ravel().tolist())
        return cross(image, tiles, bits, forward)

    def seen_symbol(self, code):
        s = symbol(self, code)
        found["tokens"].add("pixel" if s < 256 else "reference" if s < 256 + webp.LENGTHS else "cache")
        return s

    with monkeypatch.context() as m:
        m.setattr(webp, "predict", seen_predict)
        m.setattr(webp, "cross", seen_cross)
        m.setattr(webp.Reader, "symbol", seen_symbol)
        assert b"".join(x.tobytes() for x in webp.images(webp.to_media(payload))) == payload
    return found


def test_media_of_the_query_have_all_steps(monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    text = " ".join(rnd.choice(words) for _ in range(1500))
    plain = stored_steps(monkeypatch, (text + text[:2000]).encode().ljust(12800, b"\0")[:12800])
    assert 0 in plain["predictors"] and 0 in plain["factors"]
    # pixels that repeat at a distance of four bytes, and smooth ones of which red follows green
    phrase = "".join(rnd.choice(words) for _ in range(99)).ljust(600)[:600]
    repeats = "".join(phrase[4 * k : 4 * k + 40] + rnd.choice(words).ljust(8)[:8] for k in [rnd.randrange(100) for _ in range(60)])
    assert stored_steps(monkeypatch, repeats.encode().ljust(3072, b" ")[:3072])["tokens"] == {"pixel", "reference", "cache"}
    noise = np.random.default_rng(3).integers(0, 256, (64, 16))
    smooth = np.cumsum(np.random.default_rng(4).integers(-2, 3, (64, 16)), axis=1) + np.arange(64)[:, None]
    image = np.stack([noise, smooth, 3 * smooth, np.full((64, 16), 255)], 2).astype(np.uint8)
    seen = stored_steps(monkeypatch, image.tobytes())
    assert seen["predictors"] - {0}
    image = np.stack([noise // 2, noise, noise, np.full((64, 16), 255)], 2).astype(np.uint8)
    assert stored_steps(monkeypatch, image.tobytes())["factors"] - {0}


def payloads(seed):
    rnd = np.random.default_rng(seed)
    sizes = [64, 128, 192, 1024, 4096, webp_many.FRAME]
    out = [rnd.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes] + [rnd.integers(97, 101, n, dtype=np.uint8).tobytes() for n in sizes]
    out += [bytes(n) for n in sizes] + [(np.arange(n) * k % 256).astype(np.uint8).tobytes() for n in sizes for k in (1, 3, 64)]
    ramp = np.add.outer(np.arange(32) * 5, np.arange(64) * 3)
    return out + [(ramp % 256).astype(np.uint8).tobytes(), (ramp // 8 % 256).astype(np.uint8).tobytes(), "né ☃ \U0001f600".encode().ljust(64) * 31]


@pytest.mark.parametrize("seed", range(3))
def test_many_images_as_each_alone(seed):
    given = payloads(seed)
    files = webp_many.encode_many(given)
    assert files == [webp_many.encode_many([p])[0] for p in given]
    assert [webp.decode(f).tobytes() for f in files] == given
    assert webp_many.decode_many(files) == given
    assert [webp_many.decode_many([f])[0] for f in files] == given
    assert webp_many.encode_many([]) == [] and webp_many.decode_many([]) == []


@given(st.lists(st.tuples(st.integers(1, 20), st.binary(min_size=1, max_size=90)), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_any_payloads_in_a_batch(parts):
    given = [(x * 1280)[: 64 * n] for n, x in parts]
    files = webp_many.encode_many([p + bytes(-len(p) % 64) for p in given])
    assert webp_many.decode_many(files) == [webp.decode(f).tobytes() for f in files] == [p + bytes(-len(p) % 64) for p in given]


def test_codes_by_region(monkeypatch):
    rnd = random.Random(8)
    letters = "".join(rnd.choice("etaoin shrdlu") for _ in range(4096)).encode()
    signs = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(1344)).encode()
    given = [letters + signs + bytes(64), letters[:2048], signs[:1984] + bytes(64) + letters + letters[:2048], signs]
    found, cuts = [], webp_many.cuts
    monkeypatch.setattr(webp_many, "cuts", lambda *x: found.append(cuts(*x)) or found[-1])
    files = webp_many.encode_many(given)
    assert (found[0] > 0).tolist() == [True, False, True, False]
    assert [webp.decode(f).tobytes() for f in files] == webp_many.decode_many(files) == given
    assert files == [webp_many.encode_many([p])[0] for p in given]
    monkeypatch.setattr(webp_many, "cuts", lambda layout, planes: np.zeros(layout.n, np.int64))
    single = webp_many.encode_many(given)
    assert [len(a) < len(b) for a, b in zip(files, single)] == [True, False, True, False]
    assert webp_many.decode_many(single + files) == given + given


def test_every_predictor_of_many():
    rnd = np.random.default_rng(5)
    image = rnd.integers(0, 256, (24, 40, 4)).astype(np.uint8)
    for k in range(14):
        tiles = np.full((3, 5, 4), k, np.uint8)
        left, top, right, corner = image[1:, :-2], image[:-1, 1:-1], image[:-1, 2:], image[:-1, :-2]
        rest = webp.predict(image, tiles, 3, True)[1:, 1:-1]
        assert np.array_equal(image[1:, 1:-1] - webp_many.prediction(k, left, top, right, corner, -1), rest)
        planes = [np.moveaxis(x, -1, 0) for x in (left, top, right, corner)]
        wanted = np.moveaxis(image[1:, 1:-1], -1, 0).reshape(4, -1) - webp_many.prediction(k, *[x.reshape(4, -1) for x in planes])
        assert np.array_equal(wanted, np.moveaxis(rest, -1, 0).reshape(4, -1))


def test_files_of_other_writers_among_many():
    image = np.random.default_rng(6).integers(0, 9, (20, 16, 4)).astype(np.uint8)
    files = [webp.encode_with(image), webp_many.encode_many([image[:16].tobytes()])[0], webp.encode_with(image, (2, 0, 1), 5, True, 2), webp.encode_with(image[:, :7], (0,))]
    assert webp_many.decode_many(files) == [image.tobytes(), image[:16].tobytes(), image.tobytes(), image[:, :7].tobytes()]


def test_damaged_files_among_many_raise():
    good = webp_many.encode_many([bytes(np.random.default_rng(7).integers(97, 120, 2048, dtype=np.uint8))])[0]
    for bad in (b"", b"RIFF", good[:11], good[:19], good[:400], good[:-200], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp_many.decode_many([good, bad, good])
