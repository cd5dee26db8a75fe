import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.operators import fingerprint
from imprint.sources.archives import build_archive, expand_archives, read_archives, read_members
from imprint.sources.files import write_files
from imprint.sources.images import build_png, display_orientation, read_images, read_upright_images, turn_back, turn_upright


def png(bgr):
    """PNG bytes of a blue-first image."""
    height, width = bgr.shape[:2]
    lines = b"".join(b"\0" + bgr[y, :, ::-1].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def sample_card(face=(0, 140, 220), circle=True):
    image = np.full((350, 250, 3), 30, dtype=np.uint8)
    image[20:331, 20:231] = face
    if circle:
        y, x = np.mgrid[:350, :250]
        image[(y - 120) ** 2 + (x - 100) ** 2 <= 50**2] = (200, 50, 50)
    return image


def plain_signature(bgr):
    """Border histogram one pixel at a time."""
    height, width = bgr.shape[:2]
    rows, cols = max(1, int(height * 0.12)), max(1, int(width * 0.12))
    counts = np.zeros((16, 8))
    for y in range(height):
        for x in range(width):
            if rows <= y < height - rows and cols <= x < width - cols:
                continue
            b, g, r = (float(v) for v in bgr[y, x])
            high, spread = max(b, g, r), max(b, g, r) - min(b, g, r)
            if spread == 0:
                hue = 0.0
            elif high == r:
                hue = (g - b) / spread
            elif high == g:
                hue = 2 + (b - r) / spread
            else:
                hue = 4 + (r - g) / spread
            hue = np.rint(hue * 30) % 180
            saturation = np.rint(255 * spread / high) if high else 0
            counts[int(hue / 11.25), int(saturation / 32)] += 1
    return ((counts - counts.min()) / (counts.max() - counts.min())).ravel()


def distance(a, b):
    return ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count()


def test_prints_of_png_files(spark, tmp_path):
    card = sample_card()
    (tmp_path / "a.png").write_bytes(png(card))
    (tmp_path / "b.png").write_bytes(png(np.rot90(card, 2)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = read_images(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    assert {r.name for r in images.filter("failed").collect()} <= {"broken.png", ""}
    assert images.filter("failed").count() == 1
    prints = fingerprint.fingerprint_images(images.filter("NOT failed").select("name", "image"))
    got = {r.name: {p.rotation: p for p in r.prints} for r in prints.collect()}
    assert sorted(got["a.png"]) == [0, 90, 180, 270]
    # A card scanned upside down is found at the stored 180 degree print.
    assert distance(got["b.png"][0].hash, got["a.png"][180].hash) <= 4
    assert distance(got["b.png"][0].hash, got["a.png"][0].hash) > 4
    assert got["a.png"][0].color == pytest.approx(plain_signature(card), abs=1e-6)


def test_stored_rotation_comes_first(spark):
    card = sample_card()
    rows = [(1, None, ("", 350, 250, 3, 16, bytearray(card.tobytes()))), (2, 90, ("", 350, 250, 3, 16, bytearray(card.tobytes())))]
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.createDataFrame(rows, f"id long, degrees int, image {kind}")
    got = {r.id: [p.hash for p in r.prints] for r in fingerprint.fingerprint_images(images, "degrees").collect()}
    assert got[2] == got[1][1:] + got[1][:1]


def test_stack_equals_single_images():
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 256, (5, 40, 30, 3), dtype=np.uint8)
    together = fingerprint.structural_hashes(stack)
    assert list(together) == [fingerprint.structural_hashes(i[None])[0] for i in stack]
    colors = fingerprint.color_signatures(stack)
    for i, image in enumerate(stack):
        assert colors[i] == pytest.approx(plain_signature(image), abs=1e-6)


def test_hash_is_the_median_split_of_low_cosines():
    image = np.random.default_rng(2).integers(0, 256, (32, 32), dtype=np.uint8)
    code = int(fingerprint.structural_hashes(np.repeat(image[None, :, :, None], 3, axis=3))[0])
    n = np.arange(32)
    basis = lambda k: 2 * np.cos(np.pi * k * (2 * n + 1) / 64)
    low = np.array([[basis(u) @ image.astype(float) @ basis(v) for v in range(8)] for u in range(8)])
    bits = "".join("1" if x > np.median(low) else "0" for x in low.ravel())
    assert code & (1 << 64) - 1 == int(bits, 2)


def test_border_background_counts_corners_twice():
    stack = np.full((1, 10, 20, 3), 100, dtype=np.uint8)
    stack[0, 0, 0] = 0
    assert fingerprint.background_fractions(stack, 8)[0] == pytest.approx(2 / 60)
    black = np.zeros((1, 400, 400, 3), dtype=np.uint8)
    black[0, 100:275, 100:225] = 128
    assert fingerprint.background_fractions(black, 8)[0] == 1.0


def test_eligible_crops(spark):
    crops = spark.createDataFrame([(1, 1, "k"), (2, 2, "k"), (3, 3, None)], "id long, raw_scan_id long, r2_key_cropped string")
    scans = spark.createDataFrame([(1, 9, "front"), (2, 9, "back"), (3, 9, "front")], "id long, batch_id long, side string")
    assert [r.id for r in fingerprint.eligible_crops(crops, scans).collect()] == [1]


def test_archive_files(spark, tmp_path):
    body = build_archive([("d/", b""), ("d/a-front.jpg", b"one"), ("b-back.png", b"three"), ("d/a-front.jpg", b"x")])
    (tmp_path / "up.zip").write_bytes(body)
    rows = expand_archives(read_archives(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.path, r.size, bytes(r.content)) for r in rows] == [
        (1, "d/a-front.jpg", 3, b"one"), (2, "b-back.png", 5, b"three"), (3, "d/a-front.jpg", 1, b"x"),
    ]
    names = expand_archives(read_archives(spark, str(tmp_path)), with_content=False)
    assert names.filter("content IS NOT NULL").count() == 0 and names.count() == 3


def test_display_orientation(spark):
    def jpeg(order, value):
        block = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 1)
        block += struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
        body = b"Exif\0\0" + block
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0"

    files = [(1, jpeg("<", 6)), (2, jpeg(">", 3)), (3, b"\xff\xd8\xff\xda\0\0"), (4, b"\x89PNG....")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in files], "id long, content binary")
    assert {r.id: r.orientation for r in display_orientation(df).collect()} == {1: 6, 2: 3, 3: 1, 4: 1}


def test_a_broken_archive_or_member_leaves_the_others(spark):
    good = build_archive([("a.txt", b"a"), ("b.txt", b"b" * 100)])
    at = good.index(b"b.txt") + 5
    bent = good[:at] + b"\xff\xff" + good[at + 2 :]
    archives = spark.createDataFrame([("good", good), ("bad", b"no archive"), ("none", None), ("bent", bent)], "path string, content binary")
    rows = {(r.archive, r.path): r for r in expand_archives(archives).collect()}
    assert rows["good", "a.txt"].content == b"a" and rows["good", "b.txt"].error is None
    assert rows["bad", None].error and rows["none", None].error
    assert rows["bent", "a.txt"].content == b"a" and rows["bent", "b.txt"].error and rows["bent", "b.txt"].content is None


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = [(f"d{k % 3}/f{k:03d}.bin", rng.bytes(2000)) for k in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.zip").write_bytes(build_archive(files))
    (tmp_path / "small.zip").write_bytes(build_archive([("one", b"1")]))
    (tmp_path / "tiny.ZIP").write_bytes(build_archive([]))
    (tmp_path / "broken.zip").write_bytes(b"no archive" * 3000)
    (tmp_path / "note.txt").write_bytes(b"no archive at all")
    rows = read_members(spark, str(tmp_path), splitBytes=10_000)
    found = rows.withColumn("task", F.spark_partition_id()).collect()
    big = [r for r in found if r.archive == "in/big.zip"]
    assert len({r.task for r in big}) > 8
    assert sorted((r.ordinal, r.path, bytes(r.content)) for r in big) == [(k, *f) for k, f in enumerate(files)]
    assert [(r.path, r.error is not None) for r in found if r.archive == "broken.zip"] == [(None, True)]
    assert [r.path for r in found if r.archive == "small.zip"] == ["one"]
    names = read_members(spark, str(tmp_path), content="false", splitBytes=10_000).collect()
    assert len(names) == len(found) and all(r.content is None for r in names)
    large = read_members(spark, str(tmp_path / "small.zip"), memberBytes=0).collect()
    assert [(r.path, r.content) for r in large] == [("one", None)] and "more than" in large[0].error
    (tmp_path / "empty").mkdir()
    assert read_members(spark, str(tmp_path / "empty")).count() == 0


def test_images_are_turned_upright(spark, tmp_path):
    card = np.arange(5 * 3 * 3, dtype=np.uint8).reshape(5, 3, 3)
    seen = {
        1: card, 2: card[:, ::-1], 3: np.rot90(card, 2), 4: card[::-1], 5: card.transpose(1, 0, 2), 6: np.rot90(card, -1),
        7: np.rot90(card, 2).transpose(1, 0, 2), 8: np.rot90(card, 1),
    }
    for k, want in seen.items():
        assert (turn_upright(card, k) == want).all() and (turn_upright(turn_back(want, k), k) == want).all()
        (tmp_path / f"{k}.png").write_bytes(build_png(card, k))
    (tmp_path / "0.png").write_bytes(build_png(card))
    (tmp_path / "9.png").write_bytes(b"broken")
    got = {int(r.path.rsplit("/", 1)[1][0]): r for r in read_upright_images(spark, str(tmp_path)).collect() if not r.failed}
    assert set(got) == set(range(9))
    for k, want in {0: card, **seen}.items():
        assert (fingerprint.pixels(got[k].image) == want).all()


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"one"), ("b/y.bin", b""), ("z", None)], "path string, content binary")
    for _ in range(2):
        assert write_files(rows, str(tmp_path / "out")) == 3
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"one" and (tmp_path / "out/z").read_bytes() == b""
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["x.bin", "y.bin", "z"]


def test_small_ranges_of_many_archives_share_tasks(tmp_path, monkeypatch):
    from imprint.sources import archives

    monkeypatch.setattr(archives, "_MOST_TASKS", 10)
    for i in range(60):
        (tmp_path / f"{i}.zip").write_bytes(archives.build_archive([(f"a{i}", b"x" * 10)]))
    parts = archives._ZipReader({"path": str(tmp_path), "splitbytes": "64"}).partitions()
    assert len(parts) <= 20
    read = [row for p in parts for b in archives._ZipReader({"path": str(tmp_path), "splitbytes": "64"}).read(p) for row in b.column("path").to_pylist()]
    assert sorted(read) == sorted(f"a{i}" for i in range(60))
