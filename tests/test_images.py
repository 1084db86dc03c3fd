import math
import struct
import zlib

import numpy as np
import pytest

from graphflow.functions import colour
from graphflow.operators import quality, render, similarity
from graphflow.sources import images


def image(w=5, h=4, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h, w, 3)).astype(np.uint8)


def pixels_of(spark, a):
    rows = [(x, y, *map(float, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "x int, y int, c0 double, c1 double, c2 double")


def mat_file(arrays, compress=True):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, a in arrays.items():
        n = name.encode()
        small = struct.pack("<HH", 1, len(n)) + n.ljust(4, b"\0") if len(n) <= 4 else element(1, n)
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape)) + small + element(9, a.astype("<f8").tobytes(order="F"))
        one = element(14, body)
        if compress:
            z = zlib.compress(one)
            one = struct.pack("<II", 15, len(z)) + z
        out += one
    return out


@pytest.mark.parametrize(("radius", "n"), [(0, 1), (1, 5), (1.5, 9), (2, 13), (3, 29)])
def test_neighbourhood_sizes(spark, radius, n):
    assert similarity.n_offsets(radius) == n == similarity.offsets(spark, radius).count()
    assert len(similarity.local_offsets(0, 0, 10, 10, 1.5)) == 4


def test_image_similarity(spark):
    a = image()
    h, w = a.shape[:2]
    got = {(r["col"], r["row"]): r["val"] for r in similarity.image_similarity(pixels_of(spark, a), w, h, 1.5, 2.0, 9000.0).collect()}
    want = {}
    for x in range(w):
        for y in range(h):
            for dx, dy in similarity.local_offsets(x, y, w, h, 1.5):
                d = a[y, x].astype(float) - a[y + dy, x + dx]
                want[y + h * x, y + dy + h * (x + dx)] = math.exp(-(dx * dx + dy * dy) / 2 - d @ d / 9000)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-7) for k in want)
    old = {(r["col"], r["row"]) for r in similarity.image_similarity_old(pixels_of(spark, a), w, h, 1.0).collect()}
    assert (0, 1) in old and (0, w) in old and (0, h) not in old


def test_lab(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 255.0, 255.0, 255.0), (1, 0, 255.0, 0.0, 0.0), (1, 1, 12.0, 200.0, 77.0)], "x int, y int, c0 double, c1 double, c2 double")
    lab = {(r["x"], r["y"]): (r["c0"], r["c1"], r["c2"]) for r in colour.rgb_to_lab(df, eight_bit=False).collect()}
    assert lab[0, 0] == pytest.approx((0, 0, 0), abs=1e-9) and lab[0, 1][0] == pytest.approx(100, abs=1e-3)
    back = colour.lab_to_rgb(colour.rgb_to_lab(df, eight_bit=False)).collect()
    for r, s in zip(sorted(back), sorted(df.collect()), strict=True):
        assert tuple(r) == pytest.approx(tuple(s), abs=0.01)
    assert all(0 <= v <= 255 and v == int(v) for r in colour.rgb_to_lab(df).collect() for v in r[2:])


def test_greyscale(spark):
    frame = spark.createDataFrame([(i, 0.0, 0.0, float(i), 1.0) for i in range(-1, 6)], "node long, X double, Y double, Z double, I double")
    got = [r["grey"] for r in colour.greyscale(frame, "Z", 0, 4).orderBy("node").collect()]
    assert got == [0, 0, 63, 127, 191, 255, 255]
    with pytest.raises(ValueError):
        colour.greyscale(frame, "Q", 0, 1)


def slow_boundary(c, w, h):
    out = {}
    for x in range(w):
        for y in range(h):
            differing = [c[x + dx, y + dy] for dx, dy in render.SIDES if (x + dx, y + dy) in c and c[x + dx, y + dy] != c[x, y]]
            out[x, y] = differing[0] if differing else None
    return out


def test_boundary_contrast_outline(spark):
    a, (w, h) = image(6, 5), (6, 5)
    label = {(x, y): (x // 3) * 10 + (y // 3) for x in range(w) for y in range(h)}
    c = spark.createDataFrame([(x * h + y, v) for (x, y), v in label.items()], "node long, cluster long")
    want = slow_boundary(label, w, h)
    assert {(r["x"], r["y"]): r["neighbour"] for r in render.boundary(c, w, h).collect()} == want
    mean = {v: np.mean([a[y, x] for (x, y), u in label.items() if u == v], axis=0) for v in set(label.values())}
    colours = {r["cluster"]: r for r in render.cluster_colours(pixels_of(spark, a), c, w, h).collect()}
    for v, m in mean.items():
        assert [colours[v][f"m{k}"] for k in range(3)] == pytest.approx(list(m))
        assert colours[v]["spread"] == pytest.approx(sum(np.linalg.norm(a[y, x] - m) for (x, y), u in label.items() if u == v))
    for r in render.contrast(pixels_of(spark, a), c, w, h, lab=False).collect():
        n = want[r["x"], r["y"]]
        assert r["contrast"] == pytest.approx(0 if n is None else min(255, 10 * np.linalg.norm(mean[label[r["x"], r["y"]]] - mean[n])))
    for r in render.outline(pixels_of(spark, a), c, w, h, line=0.5).collect():
        assert tuple(r)[3:] == ((127.5,) * 3 if want[r["x"], r["y"]] is not None else tuple(map(float, a[r["y"], r["x"]])))
    big = {(r["x"], r["y"]): tuple(r)[3:] for r in render.outline(pixels_of(spark, a), c, w, h, hq=True).collect()}
    assert len(big) == 4 * w * h
    for (x, y), v in label.items():
        for i in (0, 1):
            for j in (0, 1):
                line = any(label.get(p, v) != v for p in ((x + 2 * i - 1, y), (x, y + 2 * j - 1)))
                assert big[2 * x + i, 2 * y + j] == ((255.0,) * 3 if line else tuple(map(float, a[y, x])))


def test_frames_have_their_own_boundaries(spark):
    c = spark.createDataFrame([(i, 1) for i in range(4)] + [(4 + i, i // 2) for i in range(4)], "node long, cluster long")
    got = {(r["frame"], r["x"], r["y"]): r["is_boundary"] for r in render.boundary(c, 2, 2).collect()}
    assert not any(v for k, v in got.items() if k[0] == 0) and all(v for k, v in got.items() if k[0] == 1)


def test_dense_ncut(spark):
    a = image(4, 4) // 16
    label = {(x, y): int(x > 1) for x in range(4) for y in range(4)}
    p = pixels_of(spark, a).selectExpr("cast(x * 4 + y as long) as node", "c0", "c1", "c2")
    c = spark.createDataFrame([(x * 4 + y, v) for (x, y), v in label.items()], "node long, cluster long")
    v = {k: a[k[1], k[0]].astype(float) for k in label}
    weight = {(p, q): math.exp(-((v[p] - v[q]) ** 2).sum() / 50) for p in label for q in label}
    shares = [sum(x for (p, q), x in weight.items() if label[p] == k == label[q]) / sum(x for (p, _), x in weight.items() if label[p] == k) for k in (0, 1)]
    got = quality.dense_ncut(p, c, 50.0).first()
    assert (got["clusters"], got["ncut"]) == (2, pytest.approx(2 - sum(shares)))


def test_png_and_pnm():
    a = image(7, 6)
    assert np.array_equal(images.decode_image(images.encode_png(a)), a) and np.array_equal(images.decode_png(images.encode_png(a[..., 0]))[..., 0], a[..., 0])
    # all five filters, by hand
    raw, above = b"", np.zeros(21, int)
    for y in range(6):
        line = a[y].ravel().astype(int)
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    plain = images.encode_png(a)
    at = plain.index(b"IDAT") - 4
    z = zlib.compress(raw)
    filtered = plain[:at] + struct.pack(">I", len(z)) + b"IDAT" + z + struct.pack(">I", zlib.crc32(b"IDAT" + z)) + plain[plain.index(b"IEND") - 4 :]
    assert np.array_equal(images.decode_png(filtered), a)
    assert np.array_equal(images.decode_pnm(b"P6 # c\n7 6\n255\n" + a.tobytes()), a)
    assert images.decode_pnm(b"P2\n2 1\n10\n5 10\n")[..., 0].tolist() == [[127.5, 255.0]]


def test_files(spark, tmp_path):
    a, b = image(5, 4, 1), image(5, 4, 2)
    (tmp_path / "b.png").write_bytes(images.encode_png(b))
    (tmp_path / "a.ppm").write_bytes(b"P6 5 4 255\n" + a.tobytes())
    (tmp_path / ".hidden.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("x")
    first = images.read_pixels(spark, str(tmp_path))
    assert first.count() == 20 and {(r["x"], r["y"]): r["c1"] for r in first.collect()} == {(x, y): float(a[y, x, 1]) for x in range(5) for y in range(4)}
    both = images.read_pixels(spark, str(tmp_path), all_frames=True)
    assert both.groupBy("frame").count().count() == 2
    files = images.write_images(both, str(tmp_path / "out"), thumbnail=True)
    made = {r["file"]: bytes(r["content"]) for r in files.collect()}
    assert sorted(made) == ["part-00000-thumb.png", "part-00000.png", "part-00001-thumb.png", "part-00001.png"]
    assert np.array_equal(images.decode_png(made["part-00001.png"]), b) and images.decode_png(made["part-00000-thumb.png"]).shape == (176, 144, 3)


@pytest.mark.parametrize("compress", [True, False])
def test_mat_frames(spark, tmp_path, compress):
    rng = np.random.default_rng(4)
    arrays = {c: rng.random((3, 4)) * (1000 if c == "I" else 1) for c in "XYZI"}
    (tmp_path / "f.mat").write_bytes(mat_file(arrays, compress))
    frame = images.read_tof(spark, str(tmp_path / "f.mat"))
    rows = {r["node"]: r for r in frame.collect()}
    assert len(rows) == 12 and all(rows[x * 3 + y][c] == arrays[c][y, x] for c in "XYZI" for x in range(4) for y in range(3))
    got = {(r["col"], r["row"]): r["val"] for r in similarity.tof_similarity(frame, 4, 3, 1.0, 2.0, 1e-4).collect()}
    d = lambda c: arrays[c][0, 0] - arrays[c][0, 1]
    assert got[0, 3] == pytest.approx(math.exp(-(d("X") ** 2 + d("Y") ** 2 + d("Z") ** 2) / 2 - d("I") ** 2 / (65535.0**2 * 1e-4)), abs=6e-7)
    (tmp_path / "g.mat").write_bytes(mat_file({"Z": arrays["Z"]}))
    with pytest.raises(Exception, match="lacks"):
        images.read_tof(spark, str(tmp_path / "g.mat")).collect()


def test_knn_graph_meets_tiles_and_keeps_ties(spark, monkeypatch):
    """Few pairs are ranked, whatever the table; ties after rounding, copies and far vectors as pair by pair."""
    import numpy as np

    monkeypatch.setattr(similarity, "ASKED", 16)
    monkeypatch.setattr(similarity, "TILE", 32)
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 1_000)
    rng = np.random.default_rng(4)
    near = rng.normal(size=(60, 8)) * 0.3
    all_ = np.concatenate([near, near[:20], near[:20] + 1e-7, rng.normal(size=(20, 8)) * 40]).astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(all_)), all_, strict=True)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    by = {i: np.array(v, np.float32) for i, v in rows}
    gap = lambda a, b: ((a - b).astype(float) ** 2).cumsum()[-1]
    want = set()
    for i, u in by.items():
        best = sorted(((-round(float(np.exp(-gap(u, v) / 0.5)), 6), j) for j, v in by.items()))
        for n, (w, j) in enumerate(best):
            if n < 6 or i == j:
                want |= {(i, j, -w), (j, i, -w)}
    assert {tuple(r) for r in similarity.knn_graph(vectors, 6, 0.5).collect()} == want
    assert similarity.knn_candidates(vectors, 6, 0.5, "vec_id", "embedding").count() <= 4 * 10 * len(rows)  # four jobs, each with the six heaviest and ties
    odd = vectors.limit(3).union(spark.createDataFrame([(500, None)], vectors.schema))
    assert (500, 500, None) in {tuple(r) for r in similarity.knn_graph(odd, 6, 0.5).collect()}
