import math
import io
import os
import random
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.operators import downloads, masks, pixels
from bandlake.sources import files


def test_archives_of_two_projects(spark):
    table = spark.createDataFrame([("p", "a.png", 3, b"one"), ("q", "a.png", 4, b"four"), ("q", "b.png", 0, b"")], "project string, path string, size_bytes long, content binary")
    parts = files.write_zip_parts(downloads.plan_parts(table, 100), table)
    found = {r.project: zipfile.ZipFile(io.BytesIO(bytes(r.archive))) for r in parts.collect()}
    assert {p: [(e.filename, z.read(e), e.external_attr >> 16) for e in z.infolist()] for p, z in found.items()} == {"p": [("a.png", b"one", 0o644)], "q": [("a.png", b"four", 0o644), ("b.png", b"", 0o644)]}
    assert sorted((r.project, r.path, bytes(r.content)) for r in files.read_zip_parts(parts).collect()) == [("p", "a.png", b"one"), ("q", "a.png", b"four"), ("q", "b.png", b"")]


def test_pyramid_built_again_replaces(spark, tmp_path):
    def build(ids, side, value):
        bands = spark.createDataFrame([(i, 0, side, side, [value] * side * side) for i in ids], "image_id int, band int, width int, height int, px array<float>")
        return files.write_pyramid(*pixels.build_pyramid(bands, min_side=1), str(tmp_path))

    build([1, 2], 4, 0.0)
    build([2], 2, 1.0)
    meta = {(r.image_id, r.level): r.size_bytes for r in files.read_pyramid_meta(spark, str(tmp_path)).collect()}
    assert meta == {(1, 0): 128, (1, 1): 32, (1, 2): 8, (2, 0): 32, (2, 1): 8}
    base = files.read_level(spark, str(tmp_path), 0).where("layer = 0").collect()
    assert sorted((r.image_id, r.width, bytes(r.rgba)[0]) for r in base) == [(1, 4, 0), (2, 2, 255)]
    assert [r.image_id for r in files.read_level(spark, str(tmp_path), 2).where("layer = 0").collect()] == [1]


def test_prompt_errors_come_from_the_first_wrong_entry(spark):
    cases = [
        ('[["a",2],[1,2,3]]', "[1,0]", masks.PAIR_X), ("[[1,2,3],[1]]", "[1,0]", masks.NOT_TWO), ('[[1,2],"b"]', "[1,0]", masks.NO_PAIR), ('[[1,"2"]]', "[1]", masks.PAIR_Y), ('[["7",2]]', "[1]", masks.PAIR_X),
        ('[{"x":"7","y":1,"label":1}]', None, masks.OBJECT_X), ('[{"x":7,"y":1,"label":1.0}]', None, masks.OBJECT_LABEL), ('[{"x":7,"label":"1"},{"y":1}]', None, masks.OBJECT_Y), ('[{"x":7,"y":1,"label":1}, 5]', None, masks.OBJECT_X),
        ("[[1,2]]", None, masks.NO_LABELS), ("[[1,2]]", "[1,2]", masks.UNEQUAL), ("[1]", None, masks.NO_SHAPE), ("{}", None, masks.NO_ARRAY), ("[1", None, masks.NO_ARRAY), ("[]", None, None), ("null", None, None), (None, None, None),
    ]
    rows = spark.createDataFrame([(k, p, m) for k, (p, m, _) in enumerate(cases)], "k int, p string, m string").select("k", masks.normalize_prompts(F.col("p"), F.col("m")).alias("n")).collect()
    assert {r.k: r.n.error for r in rows} == {k: e for k, (_, _, e) in enumerate(cases)}
    good = spark.createDataFrame([(' [ [1, -2.5e1], [3,4] ] ', "[1,0]"), ('[{"label":2,"y":0.25,"x":10}]', None)], "p string, m string").select(masks.normalize_prompts(F.col("p"), F.col("m")).alias("n")).collect()
    assert [[(p.x, p.y, p.label) for p in r.n.points] for r in good] == [[(1.0, -25.0, 1), (3.0, 4.0, 0)], [(10.0, 0.25, 2)]]


def test_each_key_is_encoded_once(spark):
    planned = spark.createDataFrame([(i, "k" if i % 3 else f"k{i % 7}") for i in range(300)], "prompt_id long, key string")
    times = spark.sparkContext.accumulator(0)

    def encode(image):
        times.add(1)
        return len(image)

    decode = lambda known, prompt: ([float(known), float(prompt["prompt_id"])], 0.5)
    got = masks.batch_segment(planned, encode, decode).collect()
    assert times.value == 8 and sorted(r.prompt_id for r in got) == list(range(300)) and all(r.polygon == [1.0, float(r.prompt_id)] for r in got)
    masks.batch_segment(planned, encode, decode, prompts_per_encode=100).collect()
    assert 8 < times.value - 8 <= 10


def traced(grid):
    """The boundary by plain walking: from the neighbour one came from, clockwise, to the next foreground pixel."""
    ys, xs = np.nonzero(grid)
    if not len(ys):
        return []
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    start = here = (int(xs[0]), int(ys[0]))
    came, path = (here[0] + 1, here[1] - 1), [start]
    while len(path) < grid.size + 2:
        at = ring.index((came[0] - here[0], came[1] - here[1]))
        for k in range(1, 9):
            x, y = here[0] + ring[(at + k) % 8][0], here[1] + ring[(at + k) % 8][1]
            if 0 <= x < grid.shape[1] and 0 <= y < grid.shape[0] and grid[y, x]:
                came, here = here, (x, y)
                break
        else:
            return path
        if here == start:
            return path
        path.append(here)
    return path


def test_outlines_by_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        h, w, share = rng.randrange(1, 12), rng.randrange(1, 12), rng.random()
        grid = np.array([[rng.random() < share for _ in range(w)] for _ in range(h)])
        assert masks.outline(grid) == traced(grid)
    ring = np.zeros((160, 160), bool)
    ring[5:-5:1, 5:-5] = np.add.outer(np.arange(150), np.arange(150)) % 11 > 1
    assert masks.outline(ring) == traced(ring)


@pytest.mark.parametrize("n", [300, 700, 3000])
def test_polygons_are_simplified_and_thinned(n):
    """A comb of ``n // 4`` teeth: beyond 500 points the outline is simplified, beyond 1000 it is thinned."""
    grid = np.zeros((4, n // 2), bool)
    grid[2:] = True
    grid[1, ::2] = True
    grid[0, ::4] = True
    path = np.array(traced(grid), np.float32)
    got = masks.mask_polygon(grid)
    if len(path) <= 500:
        assert (got == path).all()
        return
    kept = masks.simplify(path, 1.5)
    assert (got == (kept[:: len(kept) // 500] if len(kept) > 1000 else kept)).all()
    spots = [np.flatnonzero((path == p).all(1)) for p in kept]
    assert len(kept) < len(path) and all(len(x) for x in spots)


def test_first_call_on_own_frames():
    """An operator that runs Python in tasks works as the first one, away from the repository's folder."""
    code = f"""
import sys, tempfile
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from bandlake.operators import masks
frame = spark.createDataFrame([(1, 2, 1, [1, 0])], "mask_id long, width int, height int, cells array<int>")
before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
assert masks.mask_to_polygon(frame).first().polygon == [0.0, 0.0]
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
"""
    done = subprocess.run(["timeout", "170", sys.executable, "-c", code], capture_output=True, text=True, cwd="/", env=os.environ | {"PYTHONPATH": "", "PYSPARK_PYTHON": sys.executable})
    assert done.returncode == 0, done.stderr[-2000:]


def test_bundles_from_folders_with_odd_names(spark, tmp_path):
    from bandlake.sources import bundles

    root = tmp_path / "my (bundles) + 100%"
    for name in ("one set/classes.txt", "one set/labels/1 a.txt", "two#/annotations/default.json", "top.txt"):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text of {name}\nü")
    got = {(r.dataset_id, r.ord, r.path): r.content for r in bundles.read_bundles(spark, str(root)).collect()}
    assert got == {("one set", 0, "classes.txt"): "text of one set/classes.txt\nü", ("one set", 1, "labels/1 a.txt"): "text of one set/labels/1 a.txt\nü", ("two#", 0, "annotations/default.json"): "text of two#/annotations/default.json\nü"}


def test_label_files_by_suffix(spark):
    from bandlake.sources import bundles

    files = spark.createDataFrame([("d", 0, "x/11.txt", "eleven"), ("d", 1, "labels/2.txt", "two"), ("d", 2, "labels__3.txt", "three"), ("d", 3, "y/1.txt", "one"), ("e", 0, "z\\4.txt", "four")], "dataset_id string, ord long, path string, content string")
    wanted = spark.createDataFrame([("d", "labels/1.txt"), ("d", "labels/2.txt"), ("d", "labels/3.txt"), ("d", "9.txt"), ("e", "labels\\4.txt"), ("e", "2.txt")], "dataset_id string, label_path string")
    loose = {(r.dataset_id, r.label_path): r.content for r in bundles.resolve_label_files(wanted, files).collect()}
    assert loose == {("d", "labels/1.txt"): "eleven", ("d", "labels/2.txt"): "two", ("d", "labels/3.txt"): "three", ("d", "9.txt"): None, ("e", "labels\\4.txt"): "four", ("e", "2.txt"): None}
    assert bundles.resolve_label_files(wanted, files, True).where("label_path = 'labels/1.txt'").first().content == "one"


def test_numbers_go_on_over_blocks(spark):
    from bandlake.operators import ordinals

    rows = [("k" if i % 3 else "l", i * 1000, i % 2 == 0) for i in range(200)]
    got = ordinals.running(spark.createDataFrame(rows, "key string, ord long, on boolean"), "key", ["ord"], F.col("on"), "n").collect()
    for r in got:
        assert r.n == sum(on for k, o, on in rows if k == r.key and o <= r.ord)


def test_whole_masks_by_brute_force(spark):
    """Upsampling, threshold, largest component, outline and scaling of small masks, pixel by pixel."""
    one, half = np.float32(1), np.float32(0.5)

    def sample(px, w, h, x, y):
        def axis(at, size):
            low = np.floor(at)
            k = int(min(max(low, 0), size - 1))
            return k, min(k + 1, size - 1), np.float32(min(max(at - low, np.float32(0)), one))

        (x0, x1, fx), (y0, y1, fy) = axis(x, w), axis(y, h)
        at = lambda r, c: np.float32(px[r * w + c])
        return (at(y0, x0) * (one - fx) + at(y0, x1) * fx) * (one - fy) + (at(y1, x0) * (one - fx) + at(y1, x1) * fx) * fy

    def near(k, size, to):
        at = (np.float32(k) + half) * (np.float32(size) / np.float32(to)) - half
        return int(min(max(math.copysign(math.floor(abs(at) + half), at), 0), size - 1))

    def polygon(px, w, h, to_w, to_h):
        large = [[sample(px, w, h, (np.float32(i) + half) * np.float32(0.25) - half, (np.float32(j) + half) * np.float32(0.25) - half) for i in range(4 * w)] for j in range(4 * h)]
        on = [[large[near(j, 4 * h, to_h)][near(i, 4 * w, to_w)] > 0 for i in range(to_w)] for j in range(to_h)]
        best, seen = [], set()
        for j, i in [(j, i) for j in range(to_h) for i in range(to_w) if on[j][i]]:
            if (j, i) in seen:
                continue
            part, waiting = [], [(j, i)]
            seen.add((j, i))
            while waiting:
                y, x = waiting.pop()
                part.append((y, x))
                for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= b < to_h and 0 <= a < to_w and on[b][a] and (b, a) not in seen:
                        seen.add((b, a))
                        waiting.append((b, a))
            if len(part) >= len(best):  # the later of equal ones
                best = part
        grid = np.zeros((to_h, to_w), bool)
        for y, x in best:
            grid[y, x] = True
        return [float(v) for p in traced(grid) for v in p]

    rng = np.random.default_rng(12)
    rows = [(k, w, h, rng.normal(size=w * h).astype(np.float32).tolist(), tw, th) for k, (w, h, tw, th) in enumerate([(5, 4, 20, 16), (6, 3, 13, 11), (4, 4, 7, 19), (3, 7, 12, 28), (2, 2, 9, 5)] * 3)]
    rows += [(90, 3, 2, [-1.0] * 6, 9, 9), (91, 2, 3, [1.0] * 6, 8, 12)]
    frame = spark.createDataFrame(rows, "mask_id long, width int, height int, px array<float>, tw int, th int")
    got = {r.mask_id: list(r.polygon) for r in masks.postprocess_masks(frame, F.col("tw"), F.col("th")).collect()}
    assert got == {k: polygon(px, w, h, tw, th) for k, w, h, px, tw, th in rows} and any(len(p) > 20 for p in got.values())


def test_simplifying_by_recursion():
    def plain(points, epsilon):
        if len(points) < 3:
            return points
        (ax, ay), (bx, by) = points[0], points[-1]
        length = np.float32(np.hypot(bx - ax, by - ay))
        away = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length else np.hypot(x - ax, y - ay) for x, y in points[1:-1]]
        k = max(range(len(away)), key=lambda i: (away[i], -i))
        if away[k] <= epsilon:
            return [points[0], points[-1]]
        return plain(points[: k + 2], epsilon)[:-1] + plain(points[k + 1 :], epsilon)

    rng = random.Random(6)
    for _ in range(200):
        points = [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(rng.randrange(0, 40))]
        epsilon = rng.choice((0.4, 1.5, 6.3))
        assert [tuple(map(float, p)) for p in masks.simplify(np.array(points, np.float32), epsilon)] == plain(points, epsilon)
