import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.sources import images


def test_catalogue_from_a_file(spark, tmp_path):
    coco = {
        "images": [{"id": 7, "file_name": "b.tif", "height": 4, "width": 5}, {"id": 3, "file_name": "a.tif", "height": 4, "width": 5}, {"id": 9, "file_name": "b.tif", "height": 4, "width": 5}],
        "annotations": [{"id": 1, "image_id": 3, "segmentation": [[0, 0, 2, 0, 2, 2, 0, 2]]}, {"id": 2, "image_id": 3, "segmentation": {"counts": [4, 2, 14], "size": [4, 5]}}, {"id": 5, "image_id": 7, "segmentation": {"counts": "4" + "2" + ">", "size": [4, 5]}}],
    }
    (tmp_path / "x_train.json").write_text(json.dumps(coco, indent=1))
    found, notes = images.read_coco(spark, str(tmp_path / "x_train.json"))
    assert tuple(images.catalogue_counts(found, notes).first()) == (3, 3)
    assert images.first_image(found).first().id == 7 and images.find_image(found, "b.tif").id == 7
    with pytest.raises(LookupError):
        images.find_image(found, "none.tif")
    assert {r.file_name: r.image_id for r in images.name_index(found).collect()} == {"a.tif": 3, "b.tif": 9}
    rows = {r.id: r for r in notes.collect()}
    assert [rows[i].label for i in (1, 2, 5)] == [1, 2, 1] and rows[1].runs is None and rows[2].segmentation is None
    assert rows[2].runs == [4, 2, 14] and rows[5].runs == [4, 2, 14]
    drawn = images.rasterise(notes.withColumns({"image": F.col("image_id").cast("string"), "height": F.lit(4), "width": F.lit(5)})).collect()
    at = lambda image, label: sorted((r.row, r.col) for r in drawn if (r.image, r.label) == (image, label))
    assert at("3", 1) == [(0, 0), (0, 1), (1, 0), (1, 1)] and at("3", 2) == at("7", 1) == [(0, 1), (1, 1)]
    assert images.annotation_file(spark, str(tmp_path), "X") == f"{tmp_path}/x_train.json" and images.annotation_file(spark, str(tmp_path), "Y") is None


def test_packed_runs_with_differences_and_long_numbers():
    def pack(counts):
        out = ""
        for i, x in enumerate(counts):
            x -= counts[i - 2] if i > 2 else 0
            more = True
            while more:
                bits = x & 31
                x >>= 5
                more = x != -1 if bits & 16 else x != 0
                out += chr(bits + (32 if more else 0) + 48)
        return out

    import pandas as pd

    many = [[0, 5], [700, 3, 2, 1, 40_000, 9], [1, 1, 1, 1, 1]]
    got = images.unpack_runs.func(pd.Series([pack(x) for x in many] + [None]))
    assert list(got[:3]) == many and got[3] is None


def test_records_of_one_file_in_many_ranges(spark, tmp_path):
    import random

    from cellspark.sources.records import records

    r = random.Random(1)
    odd = ['a},{"b', '\\"}{', "[x]", "}", '{"images":[{', "\\", '"', "é}", "\n"]
    whole = {"info": {"a": {"b": [1, {"c": 2}]}, "images": [{"no": 1}]}, "images": [{"id": i, "file_name": r.choice(odd) * r.randrange(4)} for i in range(60)], "numbers": [1, 2, [3, 4], "x{"], "empty": []}
    whole |= {"annotations": [{"id": i, "segmentation": [[1.5, 2] * r.randrange(5)], "z": {"counts": r.choice(odd), "deep": [{"q": "}"}]}} for i in range(90)], "end": "x"}
    (tmp_path / "one.json").write_text(json.dumps(whole, ensure_ascii=False))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1100", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = sorted((x.section, x.pos, x.record) for x in records(spark, str(tmp_path / "one.json")).collect())
            assert [(s, p) for s, p, _ in found] == [("annotations", i) for i in range(90)] + [("images", i) for i in range(60)]
            assert [json.loads(t) for _, _, t in found] == whole["annotations"] + whole["images"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (tmp_path / "none.json").write_text('{"images": [], "annotations": []}')
    assert records(spark, str(tmp_path / "none.json")).count() == 0


def test_scan_in_pieces_is_the_same():
    from cellspark.sources.records import OUT, Scan

    text = json.dumps({"a": ['x\\"}{[', {"b\\": "]"}, [1, {}]], "\\": "\\\\"})
    one = Scan()
    want = list(one.brackets(text))
    assert one.depth == 0 and one.state == OUT
    for size in range(1, 9):
        scan, got = Scan(), []
        for at in range(0, len(text), size):
            got += [(at + place, opens) for place, opens in scan.brackets(text[at : at + size])]
        assert got == want and scan.state == OUT and scan.depth == 0


def tiff(a, code, data):
    entries = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, a.itemsize * 8), (259, 3, code), (273, 4, 8), (277, 3, 1), (279, 4, len(data))]
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + b"\0" * 4


def test_compressed_strips_and_a_broken_file(spark, tmp_path):
    a = np.array([[0, 300, 300, 300], [7, 7, 7, 70]], np.uint16)
    raw = a.tobytes()
    packed = bytes([1]) + raw[:2] + b"".join(bytes([1]) + raw[i : i + 2] for i in range(2, len(raw), 2))
    assert (images.decode_tiff(tiff(a, 8, zlib.compress(raw))) == a).all() and (images.decode_tiff(tiff(a, 32773, packed)) == a).all()
    b = np.array([[9, 9, 9, 9, 9, 1]], np.uint8)
    assert (images.decode_tiff(tiff(b, 32773, bytes([252, 9, 128, 0, 1]))) == b).all()
    (tmp_path / "good.tif").write_bytes(tiff(a, 8, zlib.compress(raw)))
    (tmp_path / "bad.tif").write_bytes(b"II*\0 nonsense")
    (tmp_path / "lzw.tif").write_bytes(tiff(a, 5, raw))
    got = {r.image: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {"good.tif": "completed", "bad.tif": "failed", "lzw.tif": "failed"}
    assert (got["good.tif"].height, got["good.tif"].width, got["good.tif"].bits) == (2, 4, 16) and "ValueError" in got["lzw.tif"].message
    assert images.read_pixels(spark, str(tmp_path)).agg(F.count("*"), F.sum("label")).first()[:] == (8, int(a.sum()))


def lzw(data):
    """Codes as an encoder writes them: the strings seen so far, one bit more from entry 511, 1023 and 2047 on, anew when the table is full."""
    out, held, n = bytearray(), 0, 0
    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal held, n
        held, n = held << width | code, n + width
        while n >= 8:
            out.append(held >> n - 8 & 255)
            n -= 8
        held &= (1 << n) - 1

    put(256)
    size = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c], size = size, size + 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size == 4095:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = c
    if word:
        put(table[word])
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
    put(257)
    if n:
        out.append(held << 8 - n & 255)
    return bytes(out)


def image_file(a, code=1, pack=bytes, predictor=1, tile=None, rows=None, order="<", form=1):
    """A TIFF file of the array in strips of ``rows`` rows, or in tiles."""
    high, wide = tile or (rows or a.shape[0], a.shape[1])
    parts = []
    for top in range(0, a.shape[0], high):
        for left in range(0, a.shape[1], wide):
            part = a[top : top + high, left : left + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
            parts.append(pack(part.astype(a.dtype.newbyteorder(order)).tobytes()))
    body, places = b"", []
    for part in parts:
        places.append(8 + len(body))
        body += part
    entries = [(256, 4, [a.shape[1]]), (257, 4, [a.shape[0]]), (258, 3, [a.itemsize * 8]), (259, 3, [code]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [form])]
    entries += [(322, 4, [wide]), (323, 4, [high]), (324, 4, places), (325, 4, [len(x) for x in parts])] if tile else [(273, 4, places), (278, 4, [high]), (279, 4, [len(x) for x in parts])]
    table = b""
    for tag, kind, values in sorted(entries):
        raw = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(raw) > 4:
            place, body = 8 + len(body), body + raw
            raw = struct.pack(order + "I", place)
        table += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(entries)) + table + b"\0" * 4


@pytest.mark.parametrize("order", "<>")
def test_codes_differences_tiles_and_floats(order):
    r = np.random.default_rng(5)
    smooth = (np.add.outer(np.arange(130), np.arange(70)) // 3).astype(np.uint8)
    arrays = [(smooth, 1), (r.integers(0, 256, (90, 110)).astype(np.uint8), 1), (r.integers(0, 60000, (40, 33)).astype(np.uint16), 1), (r.integers(-900, 900, (21, 50)).astype(np.int32), 2), (r.normal(size=(30, 41)).astype(np.float32), 3), (r.normal(size=(9, 5)), 3)]
    for a, form in arrays:
        for code, pack in ((1, bytes), (5, lzw), (8, zlib.compress)):
            for more in ({}, {"rows": 7}, {"tile": (16, 32)}):
                for predictor in (1, 2) if form < 3 else (1,):
                    got = images.decode_tiff(image_file(a, code, pack, predictor, order=order, form=form, **more))
                    assert got.shape == a.shape and got.dtype.kind == a.dtype.kind and (got == a).all()
    assert images._unpack_codes(lzw(b"")) == b"" and images._unpack_codes(lzw(bytes(50_000))) == bytes(50_000)


def test_files_that_fail_have_a_status(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4) / 8
    good = image_file(a, 5, lzw, form=3)
    for name, data in {"good.tif": good, "cut.tif": good[:40], "codes.tif": image_file(a.astype(np.uint8), 5, lambda x: b"\xff" * 9), "floats2.tif": image_file(a, predictor=2, form=3), "short.tif": b"II", "bits.tif": image_file(a.astype(np.uint64))}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.image: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in found.items()} == {k: "completed" if k == "good.tif" else "failed" for k in found} and len(found) == 6
    assert found["good.tif"].kind == "f" and all(r.message for r in found.values() if r.status == "failed")
    pixels = images.explode_pixels(images.read_images(spark, str(tmp_path)), "intensity", floats=True).collect()
    assert {(p.row, p.col): p.intensity for p in pixels} == {(i, j): float(a[i, j]) for i in range(3) for j in range(4)}


def test_parameters_tables_and_models(spark, tmp_path):
    path = tmp_path / "best.json"
    full = {"selected_parameters": {"diameter": None, "cellprob_threshold": 0.0, "flow_threshold": 0.4, "min_size": 15}}
    path.write_text(json.dumps(full))
    report, chosen = images.load_parameters(spark, str(path))
    assert report["model"] == "cpsam_v2" and chosen["min_size"] == 15
    for wrong in ({}, {"selected_parameters": {"diameter": 1}}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(KeyError):
            images.load_parameters(spark, str(path))
    images.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/t", csv=True)
    assert images.read_table(spark, f"{tmp_path}/t", "a int, b string").first()[:] == (1, "x")
    with pytest.raises(Exception, match="CSV|header|Column"):
        images.read_table(spark, f"{tmp_path}/t", "z int, b string").collect()
    with pytest.raises(ValueError, match="missing columns: q"):
        images.require_columns(spark.range(1), ["id", "q"])
    with pytest.raises(ValueError):
        images.validate_cluster_labels(spark.createDataFrame([(1,), (3,)], "c int"), "c")


def test_notes_drawn_together_are_those_drawn_one_by_one(spark, monkeypatch):
    g = np.random.default_rng(5)
    monkeypatch.setattr(images, "STEP_PIXELS", 300)
    rows, want = [], set()
    for i in range(80):
        h, w = (int(v) for v in g.integers(6, 30, 2))
        whole = i % 3 == 0  # corners on centres and between pixels
        polygons = [(g.integers(-4, 34, 2 * int(g.integers(2, 9))) / (1 if whole else 2)).astype(float).tolist() for _ in range(int(g.integers(0, 4)))]
        runs = g.integers(0, 40, int(g.integers(0, 30))).tolist() if i % 4 == 0 else None
        rows.append((f"i{i % 5}", i, None if i % 7 == 0 else polygons, runs, h, w))
        mask = images.fill_runs(runs or [h * w], h, w).copy()
        for p in polygons if i % 7 else ():
            if len(p) >= 6:
                mask |= images.fill_polygon(np.array(p).reshape(-1, 2), h, w)
        want |= {(f"i{i % 5}", int(r), int(c), i) for r, c in zip(*np.nonzero(mask), strict=True)}
    notes = spark.createDataFrame(rows, "image string, label long, segmentation array<array<double>>, runs array<int>, height int, width int")
    got = [tuple(r) for r in images.rasterise(notes).collect()]
    assert len(got) == len(want) and set(got) == want
    of, flats = np.array([0, 0]), [[1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0], [2.0, 1.0, 6.0, 1.0, 6.0, 3.0, 2.0, 3.0]]
    assert len(images.polygon_pixels(of, flats, np.array([9]), np.array([5]))[0]) == 6 + 6


def test_sorted_parts_become_one_file(spark, tmp_path):
    df = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value"))
    images.write_lines(df, str(tmp_path / "x"))
    found = [f for f in (tmp_path / "x").iterdir() if f.name[0] not in "._"]
    assert len(found) == 1 and found[0].read_text().split() == [str(i) for i in range(1000)]
    assert spark.read.text(str(tmp_path / "x")).count() == 1000
