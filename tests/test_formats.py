"""JPEG, GIF, orientation and profiles, against files written by the JVM."""

import struct
import zlib

import numpy as np
import pytest

from pelgrain.kernels import formats, jpeg, png
from pelgrain.options import Options
from pelgrain.sources import images as I


def painting(h=45, w=70):
    y, x = np.mgrid[:h, :w]
    px = np.full((h, w, 4), 255, np.uint8)
    px[..., 0], px[..., 1], px[..., 2] = 255 * x // w, 255 * y // h, 128 + 100 * np.sin(x / 9) * np.cos(y / 7)
    px[(x - 30) ** 2 + (y - 20) ** 2 < 90, :3] = (250, 20, 40)
    return px


def written(spark, px, kind, progressive=False, quality=0.9, grey=False):
    """The image as the JVM writes it, and as the JVM reads that again."""
    jvm = spark._jvm
    h, w = px.shape[:2]
    img = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    ints = spark._sc._gateway.new_array(jvm.int, w * h)
    for k, (r, g, b) in enumerate(px[..., :3].reshape(-1, 3).tolist()):
        ints[k] = (r << 16) | (g << 8) | b
    img.setRGB(0, 0, w, h, ints, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    if kind == "gif":
        jvm.javax.imageio.ImageIO.write(img, "gif", out)
    else:
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        param = writer.getDefaultWriteParam()
        param.setCompressionMode(2)
        param.setCompressionQuality(float(quality))
        param.setProgressiveMode(1 if progressive else 0)
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
        stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    flat = back.getRGB(0, 0, w, h, None, 0, w)
    seen = np.array([v & 0xFFFFFF for v in flat]).reshape(h, w)
    return data, np.stack([seen >> 16, seen >> 8 & 255, seen & 255], axis=2)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_jpeg_is_what_the_jvm_reads(spark, progressive, quality):
    data, want = written(spark, painting(), "jpeg", progressive, quality)
    assert (0xC2 in {m for m, *_ in jpeg.segments(data)}) == progressive
    got = formats.decode(data)
    off = np.abs(got[..., :3].astype(int) - want)
    # colour channels of half size are repeated here and smoothed there
    assert got.shape == (45, 70, 4) and off.mean() < 4 and np.abs(got[..., :3].mean(axis=2) - want.mean(axis=2)).mean() < 2
    assert formats.dimensions(data) == (70, 45)


def test_grey_jpeg(spark):
    data, want = written(spark, painting(), "jpeg", grey=True)
    got = formats.decode(data)
    assert np.abs(jpeg.decode_jpeg(data)[..., 0].astype(int) - got[..., 0]).max() <= 1 and (got[..., 0] == got[..., 2]).all()


def test_gif_is_what_the_jvm_reads(spark):
    px = painting()
    px[..., :3] = px[..., :3] // 64 * 64
    data, want = written(spark, px, "gif")
    got = formats.decode(data)
    assert (got[..., :3] == want).all() and (got[..., 3] == 255).all() and formats.dimensions(data) == (70, 45)


def test_broken_files_are_told(spark):
    data, _ = written(spark, painting(), "jpeg")
    gif, _ = written(spark, painting(), "gif")
    for bad in (data[:200], data[:2], b"\xff\xd8\xff" + b"\0" * 50, gif[:20], gif[:13] + b"\x3b", b"RIFF1234WEBPVP8 "):
        with pytest.raises(png.ImageError):
            formats.decode(bad)
    assert formats.decode(data[: len(data) * 2 // 3]).shape == (45, 70, 4)  # cut off in the scan: the rest is grey


def exif(turn, order=">"):
    return (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0)


def chunked(px, **chunks):
    """A PNG with further chunks before its data."""
    data = png.encode_png(px)
    extra = b"".join(struct.pack(">I", len(b)) + k.encode() + b + struct.pack(">I", zlib.crc32(k.encode() + b)) for k, b in chunks.items())
    return data[:33] + extra + data[33:]


def test_orientation_turns_images():
    px = painting(5, 3)
    corner = {1: (0, 0), 2: (0, 2), 3: (4, 2), 4: (4, 0), 5: (0, 0), 6: (4, 0), 7: (4, 2), 8: (0, 2)}  # what ends up top left
    for turn, at in corner.items():
        got = formats.decode(chunked(px, eXIf=exif(turn, "<" if turn % 2 else ">")))
        assert got.shape == ((3, 5, 4) if turn > 4 else (5, 3, 4)) and (got[0, 0] == px[at]).all()
    for bad in (b"", b"MM", exif(9), exif(1)[:-4]):
        assert formats.orientation(bad) == 1
    assert formats.orientation(None) == 1


def icc(columns, curve):
    """A profile of primaries and one curve for all channels."""
    xyz = lambda v: b"XYZ \0\0\0\0" + struct.pack(">3i", *(round(x * 65536) for x in v))
    tags = {b"rXYZ": xyz(columns[0]), b"gXYZ": xyz(columns[1]), b"bXYZ": xyz(columns[2]), b"rTRC": curve, b"gTRC": curve, b"bTRC": curve}
    head, at, table, body = bytearray(128), 132 + 12 * len(tags), b"", b""
    head[16:20] = b"RGB "
    for k, v in tags.items():
        table += struct.pack(">4sII", k, at + len(body), len(v))
        body += v
    return bytes(head) + struct.pack(">I", len(tags)) + table + body


def test_profiles_are_converted():
    px = painting(20, 20)
    ramp = np.arange(4096) / 4095
    srgb = np.where(ramp <= 0.04045, ramp / 12.92, ((ramp + 0.055) / 1.055) ** 2.4)
    same = b"curv\0\0\0\0" + struct.pack(">I", 4096) + (srgb * 65535 + 0.5).astype(">u2").tobytes()
    para = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *(round(x * 65536) for x in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
    own = formats.SRGB_D50.T
    for curve in (same, para):
        got = formats.decode(chunked(px, iCCP=b"own\0\0" + zlib.compress(icc(own, curve))))
        assert np.abs(got.astype(int) - px).max() <= 1
    linear = formats.decode(chunked(px, iCCP=b"lin\0\0" + zlib.compress(icc(own, b"curv\0\0\0\0\0\0\0\0"))))
    v = px[..., :3] / 255
    assert np.abs(linear[..., :3] - np.floor(np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)).max() <= 1
    swapped = formats.decode(chunked(px, iCCP=b"swp\0\0" + zlib.compress(icc(own[[2, 1, 0]], same))))
    assert np.abs(swapped[..., :3].astype(int) - px[..., 2::-1]).max() <= 1 and (swapped[..., 3] == 255).all()
    for bad in (b"none", b"x\0\0junk", b"x\0\0" + zlib.compress(b"\0" * 16 + b"GRAY" + b"\0" * 200)):
        assert (formats.decode(chunked(px, iCCP=bad)) == px).all()


def test_decode_of_a_mixed_folder(spark, tmp_path):
    px = painting()
    for name, data in (("a.jpg", written(spark, px, "jpeg")[0]), ("b.gif", written(spark, px, "gif")[0]), ("c.png", png.encode_png(px)), ("d.webp", b"RIFF1234WEBPVP8 ")):
        (tmp_path / name).write_bytes(data)
    got = {r.image_id[-5:]: r for r in I.decode(I.read_files(spark, f"file://{tmp_path}/*")).collect()}
    assert all((got[k].width, got[k].height, got[k].error) == (70, 45, None) for k in ("a.jpg", "b.gif", "c.png")) and got["a.jpg"].was_jpeg and not got["c.png"].was_jpeg
    assert got[".webp"].error.code == "InvalidInput"
    small = {r.image_id[-5:]: r.error for r in I.decode(I.read_files(spark, f"file://{tmp_path}/*"), Options(max_pixels=1000)).collect()}
    assert small["a.jpg"].kind == small["b.gif"].kind == small["c.png"].kind == "pixels"
    few = {r.image_id[-5:]: r for r in I.decode(I.read_files(spark, f"file://{tmp_path}/*", Options(max_input_bytes=30)), Options(max_input_bytes=30)).collect()}
    assert few["a.jpg"].error.kind == "input-bytes" and few["a.jpg"].error.value == (tmp_path / "a.jpg").stat().st_size and few[".webp"].error.kind is None
