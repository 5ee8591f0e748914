"""JPEG against the JVM's own codec, in both directions, and against damaged files."""

import numpy as np
import pytest

from framelake import sources
from framelake.kernels import codecs, jpeg
from framelake.sources import files


def picture(h, w, n, seed=3):
    y, x = np.mgrid[:h, :w]
    noise = np.random.default_rng(seed).normal(0, 4, (h, w))
    return np.clip(np.stack([(np.sin(x / 9 + k) + np.cos(y / 7 - k)) * 60 + 128 + noise for k in range(n)], 2), 0, 255).astype(np.uint8)


def jvm_decoded(spark, data):
    """Pixels by the JVM, with the colours in this library's order."""
    j = spark._jvm
    image = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(data))
    out = j.java.io.ByteArrayOutputStream()
    j.javax.imageio.ImageIO.write(image, "bmp", out)
    return codecs.read_bmp(bytes(out.toByteArray()))


def jvm_encoded(spark, image, progressive, quality=0.9):
    """A file by the JVM's writer, which halves the colour planes."""
    j = spark._jvm
    source = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(codecs.write_bmp(image)))
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(quality)
    settings.setProgressiveMode(1 if progressive else 0)
    out = j.java.io.ByteArrayOutputStream()
    writer.setOutput(j.javax.imageio.stream.MemoryCacheImageOutputStream(out))
    writer.write(None, j.javax.imageio.IIOImage(source, None, None), settings)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("shape", [(1, 1, 3), (8, 8, 3), (17, 33, 3), (61, 90, 3), (64, 50, 1)])
@pytest.mark.parametrize("quality", [20, 85, 100])
@pytest.mark.parametrize("subsample", [False, True])
def test_written_files_read_the_same_in_the_jvm(spark, shape, quality, subsample):
    data = jpeg.write_jpeg(picture(*shape), quality, subsample)
    ours, theirs = jpeg.read_jpeg(data).astype(int), jvm_decoded(spark, data).astype(int)
    assert ours.shape == shape and np.abs(ours - theirs[..., : shape[2]]).max() <= 3


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (16, 16), (17, 33), (75, 130)])
def test_files_of_the_jvm(spark, progressive, size):
    data = jvm_encoded(spark, picture(*size, 3), progressive)
    assert (b"\xff\xc2" in data) == progressive
    ours, theirs = jpeg.read_jpeg(data).astype(int), jvm_decoded(spark, data).astype(int)
    assert np.abs(ours - theirs).max() <= 3


def test_quality_alpha_and_flat_images():
    image = picture(80, 100, 4)
    error = [np.abs(jpeg.read_jpeg(jpeg.write_jpeg(image, q)).astype(int) - image[..., :3]).mean() for q in (10, 50, 90, 100)]
    assert error == sorted(error, reverse=True) and error[-1] < 1
    assert np.abs(jpeg.read_jpeg(jpeg.write_jpeg(np.full((30, 20, 3), 77, np.uint8))).astype(int) - 77).max() <= 1
    checker = (np.indices((40, 40)).sum(0) % 2 * 255).astype(np.uint8)[..., None]
    assert np.abs(jpeg.read_jpeg(jpeg.write_jpeg(checker, 100)).astype(int) - checker).max() <= 2


def test_rare_symbols_have_codes_of_at_most_16_bits():
    from collections import Counter

    counts = Counter({k: 2**k for k in range(40)})
    numbers, symbols, codes, sizes = jpeg._codes(counts)
    assert sum(numbers) == 40 and sorted(symbols) == list(range(40)) and sizes[:40].max() <= 16
    words = [format(codes[k], f"0{sizes[k]}b") for k in range(40)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert not any(set(w) == {"1"} for w in words)


def test_restart_intervals():
    """The pieces between restart markers start anew: a file of two equal halves cut by a marker."""
    flat = jpeg.write_jpeg(np.full((8, 8, 1), 200, np.uint8))
    head, scan = flat[: flat.index(b"\xff\xda")], flat[flat.index(b"\xff\xda") :]
    at = head.index(b"\xff\xc0")
    wide = head[: at + 7] + (16).to_bytes(2, "big") + head[at + 9 :]
    body = scan[10:-2]
    data = wide + b"\xff\xdd\0\x04\0\x01" + scan[:10] + body + b"\xff\xd0" + body + b"\xff\xd9"
    assert np.abs(jpeg.read_jpeg(data).astype(int) - 200).max() <= 1 and jpeg.read_jpeg(data).shape == (8, 16, 1)


def test_damaged_files_are_value_errors():
    good = jpeg.write_jpeg(picture(40, 40, 3))
    for bad in (b"", b"\xff\xd8", good[:100], good[: len(good) // 2], b"\xff\xd8\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc9")):
        with pytest.raises(ValueError):
            jpeg.read_jpeg(bad)
    rng = np.random.default_rng(5)
    for _ in range(150):
        bad = bytearray(good)
        for place in rng.integers(2, len(good), 3):
            bad[place] = rng.integers(0, 256)
        try:
            jpeg.read_jpeg(bytes(bad))
        except ValueError:
            pass
    with pytest.raises(ValueError):
        jpeg.write_jpeg(np.zeros((0, 4, 3), np.uint8))


def test_folders_of_photos(spark, tmp_path):
    image = picture(20, 30, 3)
    (tmp_path / "a.jpg").write_bytes(jpeg.write_jpeg(image, 95))
    (tmp_path / "b.jpg").write_bytes(jvm_encoded(spark, image, True))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    slow = {r.path.rpartition("/")[2]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    fast = {r.path.rpartition("/")[2]: r for r in files.read_photos(spark, str(tmp_path)).collect()}
    assert set(slow) == set(fast) == {"a.jpg", "b.jpg", "bad.jpg"}
    assert slow["bad.jpg"].error and fast["bad.jpg"].error
    for name in ("a.jpg", "b.jpg"):
        a, b = (np.frombuffer(r[name].data, np.uint8).astype(int) for r in (slow, fast))
        assert (slow[name].w, slow[name].h, slow[name].channels) == (fast[name].w, fast[name].h, fast[name].channels) == (30, 20, 3)
        assert np.abs(a - b).max() <= 3
    out = files.encode_compact(sources.read_images(spark, str(tmp_path), "a.jpg"), "jpeg").first()
    assert np.abs(jpeg.read_jpeg(bytes(out.content)).astype(int) - image).mean() < 5
