"""Photo files: decoding, finding, packing into containers and reading by ranges, against plain readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import photos
from twinlens.sources.containers import pack_files, packed_index, read_packed
from twinlens.sources.stored import materialize


def plain_grid(pixels, rows=8, columns=9):
    h, w = len(pixels), len(pixels[0])
    out = []
    for r in range(rows):
        for c in range(columns):
            lines, across = range(r * h // rows, max((r + 1) * h // rows, r * h // rows + 1)), range(c * w // columns, max((c + 1) * w // columns, c * w // columns + 1))
            out.append(sum(int(pixels[i][j]) for i in lines for j in across) * 256 // (len(lines) * len(across)))
    return out


def plain_hash(grid):
    bits = [grid[r * 9 + c + 1] > grid[r * 9 + c] for r in range(8) for c in range(8)]
    value = int("".join("01"[b] for b in bits), 2)
    return value - 2**64 if value >= 2**63 else value


def picture(rng, h, w, most=255, raw=False):
    pixels = rng.integers(0, most + 1, (h, w))
    head = f"P{5 if raw else 2}\n# a comment\n{w} {h}\n{most}\n".encode()
    body = pixels.astype(">u2" if most > 255 else np.uint8).tobytes() if raw else b"\n".join(b" ".join(b"%d" % p for p in row) for row in pixels)
    return head + body, pixels.tolist()


@pytest.mark.parametrize("shape", [(8, 9), (80, 90), (37, 101), (3, 2), (1, 1)])
def test_decode_pgm(shape):
    rng = np.random.default_rng(sum(shape))
    for most, raw in ((255, False), (255, True), (65535, True), (15, False)):
        content, pixels = picture(rng, *shape, most, raw)
        assert photos.decode_pgm(content) == plain_grid(pixels)


@pytest.mark.parametrize("content", [None, b"", b"P6\n1 1\n255\n\0\0\0", b"P2\n2 2\n255\n1 2 3", b"P5\n9 9\n255\nabc", b"P2\n0 4\n255\n", b"P2\n1 1\n9\n10", b"P2\n1 1\n255\nx"])
def test_unreadable(content):
    with pytest.raises(ValueError):
        photos.decode_pgm(content)


def test_files_to_hashes(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for folder in ("", "one", "two", "one/deep"):
        (tmp_path / "photos" / folder).mkdir(parents=True, exist_ok=True)
        for i in range(12):
            content, pixels = picture(rng, int(rng.integers(1, 40)), int(rng.integers(1, 40)), raw=bool(i % 2))
            key = f"{folder.replace('/', '_') or 'root'}{i}"
            (tmp_path / "photos" / folder / f"{key}.{'PGM' if i % 3 else 'pgm'}").write_bytes(content if i != 5 else b"broken")
            want[key] = plain_hash(plain_grid(pixels)) if i != 5 else None
    (tmp_path / "photos" / "one" / "root0.pgm").write_bytes(picture(rng, 9, 9)[0])  # the root's own file comes first
    (tmp_path / "photos" / "notes.txt").write_text("not a photo")
    root = f"file://{tmp_path}/photos"
    wanted = sorted(k for k in want if not k.endswith("7"))
    keys = spark.createDataFrame([(k,) for k in [*wanted, "absent"]], "image_key string")
    located = materialize(photos.locate_photos(spark, [root], keys, ("pgm",)), "test-paths")
    assert located.count() == 33  # those of a folder in a folder aren't looked at
    files = photos.read_files(located, [root])
    containers = materialize(pack_files(files, 2000), "test-containers")
    assert 1 < containers.count() < 33 and packed_index(containers).count() == 33
    whole = {r["image_key"]: bytes(r["content"]) for r in read_packed(containers).collect()}
    assert whole == {r["image_key"]: bytes(r["content"]) for r in files.collect()}
    few = keys.where(F.col("image_key").isin("one1", "two2", "absent"))
    assert {r["image_key"]: bytes(r["content"]) for r in read_packed(containers, few).collect()} == {k: whole[k] for k in ("one1", "two2")}
    got = {r["image_key"]: r["dhash"] for r in photos.hash_photos(read_packed(containers, keys), photos.decode_pgm).collect()}
    assert got == {k: want[k] for k in wanted if not k.startswith("one_deep")}


def test_odd_contents(spark):
    files = spark.createDataFrame([("a", "p", b""), ("b", "p", None), ("c", "p", b"x" * 5000), ("c", "q", b"second"), (None, "r", b"no key")], "image_key string, path string, content binary")
    containers = materialize(pack_files(files.coalesce(1), 100), "test-containers")
    got = sorted((r["image_key"] or "", r["path"], bytes(r["content"])) for r in read_packed(containers).collect())
    assert got == [("", "r", b"no key"), ("a", "p", b""), ("b", "p", b""), ("c", "p", b"x" * 5000), ("c", "q", b"second")]
    assert pack_files(files.limit(0)).count() == 0
