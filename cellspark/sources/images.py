"""Annotation files, label images and file listings as DataFrames."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import written
from .records import records

#: A segmentation is read as text: a list of polygons, or run lengths.
IMAGE, ANNOTATION = "id bigint, file_name string, height int, width int", "id bigint, image_id bigint, segmentation string"
DEFAULT_MODEL = "cpsam_v2"
PARAMETERS = ("diameter", "cellprob_threshold", "flow_threshold", "min_size")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images with their position in the file, annotations with label numbers by position).

    An annotation has ``segmentation`` (polygons) or ``runs`` (lengths of background and
    cell in turn, down the columns), the other is NULL.  One large file is read by many tasks.
    """
    every = written(records(spark, path))
    part = lambda name, schema: every.where(F.col("section") == name).select("pos", F.from_json("record", schema).alias("r")).select("pos", "r.*")
    images, notes = part("images", IMAGE), part("annotations", ANNOTATION)
    label = F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))
    polygons = F.when(F.col("segmentation").startswith("["), F.from_json("segmentation", "array<array<double>>"))
    counts = F.get_json_object("segmentation", "$.counts")
    runs = F.when(counts.startswith("["), F.from_json(counts, "array<int>")).when(counts.isNotNull(), unpack_runs(counts))
    return images, notes.withColumns({"label": label, "runs": runs}).withColumn("segmentation", polygons)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_runs(counts: pd.Series) -> pd.Series:
    """Run lengths from their packed text: five bits a character from 48 on, the sixth for more to come; from the third on, differences to the last but one."""

    def one(text: str | None) -> list[int] | None:
        if text is None:
            return None
        out: list[int] = []
        value = shift = 0
        for ch in text:
            bits = ord(ch) - 48
            value |= (bits & 31) << shift
            shift += 5
            if not bits & 32:
                if bits & 16:
                    value -= 1 << shift
                out.append(value + out[-2] if len(out) > 2 else value)
                value = shift = 0
        return out

    return counts.map(one)


def catalogue_counts(images: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: images and annotations."""
    return images.agg(F.count("*").alias("images")).crossJoin(notes.agg(F.count("*").alias("annotations")))  # one row each


def first_image(images: DataFrame) -> DataFrame:
    """The first in the file's order."""
    return images.orderBy("pos").limit(1)


def find_image(images: DataFrame, file_name: str):
    """The first image of that name; an error if there is none."""
    row = images.where(F.col("file_name") == file_name).orderBy("pos").first()
    if row is None:
        raise LookupError(f"no image {file_name}")
    return row


def name_index(images: DataFrame) -> DataFrame:
    """(file_name, image_id): of a repeated name the last stands."""
    return images.groupBy("file_name").agg(F.max_by("id", "pos").alias("image_id"))


def annotation_file(spark: SparkSession, folder: str, line: str) -> str | None:
    """The first that exists of the line's two usual names in ``folder``, or None."""
    for name in (f"{line.lower()}_train.json", f"{line}_train.json"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return f"{folder.rstrip('/')}/{name}"
    return None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a declared schema; a header that differs is an error, empty fields are NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, file_name), contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def decode_tiff(data: bytes) -> np.ndarray:
    """A single-channel TIFF of whole numbers or floats, losslessly, in strips or tiles.

    Stored plainly, deflated, packed in runs of bytes or in LZW codes; with or without differences along the rows.
    """
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
        raw = entry[8:] if n * size <= 4 else data[struct.unpack(order + "I", entry[8:])[0] :]
        tags[tag] = struct.unpack(order + code * n, raw[: n * size])
    unpack = {1: bytes, 5: _unpack_codes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bytes}.get(tags.get(259, (1,))[0])
    predictor, form = tags.get(317, (1,))[0], {1: "u", 2: "i", 3: "f"}.get(tags.get(339, (1,))[0])
    bits = tags.get(258, (1,))[0]
    if unpack is None or form is None or tags.get(277, (1,))[0] != 1 or predictor not in (1, 2) or predictor == 2 and form == "f":
        raise ValueError("only single-channel images, stored plainly, deflated, packed or in LZW codes, with differences of whole numbers or none")
    if bits not in ((16, 32, 64) if form == "f" else (8, 16, 32)):
        raise ValueError(f"{bits} bits a pixel")
    width, height, kind = tags[256][0], tags[257][0], np.dtype(f"{order}{form}{bits // 8}")
    tiled = 324 in tags
    high, wide = (tags[323][0], tags[322][0]) if tiled else (min(height, tags.get(278, (height,))[0]), width)
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // wide)
    out = np.zeros((-(-height // high) * high, across * wide), kind)
    if len(places) != across * (len(out) // high):
        raise ValueError(f"{len(places)} parts do not make an image")
    for i, (o, n) in enumerate(zip(places, sizes, strict=True)):
        top, left = i // across * high, i % across * wide
        rows = high if tiled else min(high, height - top)
        part = np.frombuffer(unpack(data[o : o + n])[: rows * wide * kind.itemsize], kind).reshape(rows, wide)
        out[top : top + rows, left : left + wide] = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part
    return out[:height, :width]


def _unpack_codes(data: bytes) -> bytes:
    """LZW: codes of 9 to 12 bits, the highest first, one bit more as soon as the next code but one would need it; 256 begins anew, 257 ends."""
    out, table, before = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], b""
    width, held, n = 9, 0, 0
    for byte in data:
        held, n = (held << 8 | byte) & 0xFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = held >> n & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if not before:
            if code > 255:
                raise ValueError("a code before its string")
            now = table[code]
        else:
            if code > len(table) or code < len(table) and 255 < code < 258:
                raise ValueError("a code before its string")
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
        out += now
        before = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpack_bytes(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:  # n + 1 bytes as they are
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:  # the next one 257 - n times; 128 says nothing
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def encode_tiff(image: np.ndarray) -> bytes:
    """The same, one strip, little endian."""
    image = np.ascontiguousarray(image, image.dtype.newbyteorder("<"))
    pixels = image.tobytes()
    entries = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(pixels))]
    table = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
    return b"II*\0" + struct.pack("<I", 8 + len(pixels)) + pixels + struct.pack("<H", len(entries)) + table + b"\0" * 4


def read_images(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(image, status, message, height, width, bits, pixels, kind) of every file: decoded pixels row by row as little-endian bytes.

    ``kind`` is u, i or f: whole numbers without and with a sign, floats.

    A file that can't be decoded has the status ``failed``, a message and no pixels; the
    others are ``completed``.  Spark does not list files without a byte; they have no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    a = decode_tiff(content)
                    row = (name, "completed", None, a.shape[0], a.shape[1], a.itemsize * 8, a.astype(a.dtype.newbyteorder("<")).tobytes(), a.dtype.kind)
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    row = (name, "failed", f"{type(e).__name__}: {e}", None, None, None, None, None)
                yield pd.DataFrame([row], columns=["image", "status", "message", "height", "width", "bits", "pixels", "kind"]).astype({"height": "Int32", "width": "Int32", "bits": "Int32"})

    return files.mapInPandas(task, "image string, status string, message string, height int, width int, bits int, pixels binary, kind string")


def explode_pixels(images: DataFrame, value: str = "label", floats: bool = False) -> DataFrame:
    """(image, row, col, value) of every pixel of ``read_images``: whole numbers, or doubles where ``floats``."""
    to, name = (np.float64, "double") if floats else (np.int64, "long")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                r, c = np.indices((int(x.height), int(x.width)))
                yield pd.DataFrame({"image": x.image, "row": r.ravel(), "col": c.ravel(), value: np.frombuffer(x.pixels, f"<{x.kind}{int(x.bits) // 8}").astype(to)})

    return images.where("status = 'completed'").select("image", "height", "width", "bits", "pixels", "kind").mapInPandas(task, f"image string, row int, col int, {value} {name}")


def read_pixels(spark: SparkSession, folder: str, pattern: str = "*.tif", value: str = "label") -> DataFrame:
    """(image, row, col, value) of every pixel; a file that fails gives no rows (``read_images`` tells which)."""
    return explode_pixels(read_images(spark, folder, pattern), value)


def label_images(pixels: DataFrame, images: DataFrame, label: str = "label") -> DataFrame:
    """(image, tiff): each image's labels as a 32-bit TIFF file's bytes; ``images`` has image, height, width.

    Pixels that are not given are background.  An image is one group of bounded size.
    """
    rows = images.select("image", "height", "width").join(pixels.where(F.col(label) > 0).select("image", "row", "col", F.col(label).alias("__label")), "image", "left")

    def draw(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(x.height.iloc[0]), int(x.width.iloc[0])), np.uint32)
        x = x.dropna(subset=["__label"])
        a[x["row"].astype(int), x["col"].astype(int)] = x["__label"].astype(np.int64)
        return pd.DataFrame({"image": [key[0]], "tiff": [encode_tiff(a)]})

    return rows.groupBy("image").applyInPandas(draw, "image string, tiff binary")


def export_tiff(tiffs: DataFrame, folder: str, suffix: str = "_optimized_masks.tif") -> DataFrame:
    """Writes each (image, tiff) to a file of its own in ``folder``, which all executors share; (image, path) of what was written.

    A file is written under another name first and then renamed, so that a task that is
    lost leaves no half of one.
    """
    from pyarrow import fs

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(at, recursive=True)
        for batch in batches:
            paths = []
            for image, data in zip(batch.image, batch.tiff, strict=True):
                path = f"{at}/{image.rsplit('.', 1)[0]}{suffix}"
                draft = f"{path}.{zlib.crc32(data):08x}.part"
                with files.open_output_stream(draft) as out:
                    out.write(data)
                files.move(draft, path)
                paths.append(path)
            yield pd.DataFrame({"image": batch.image, "path": paths})

    out = tiffs.select("image", "tiff").mapInPandas(task, "image string, path string")
    return tiffs.sparkSession.createDataFrame(out.collect(), "image string, path string")  # a name and a path a file


def fill_polygon(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies inside, by the even-odd rule."""
    out = np.zeros((height, width), bool)
    x, y = points[:, 0], points[:, 1]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    for row in range(max(0, int(np.floor(y.min()))), min(height, int(np.ceil(y.max())) + 1)):
        at = row + 0.5
        cut = (y <= at) != (y2 <= at)
        cross = np.sort(x[cut] + (at - y[cut]) * (x2[cut] - x[cut]) / (y2[cut] - y[cut]))
        for a, b in zip(cross[::2], cross[1::2], strict=True):
            out[row, max(0, int(np.ceil(a - 0.5))) : max(0, int(np.ceil(b - 0.5)))] = True
    return out


def fill_runs(runs, height: int, width: int) -> np.ndarray:
    """The mask of run lengths: background and cell in turn, down the columns."""
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)[: height * width]
    return np.pad(flat, (0, height * width - len(flat))).reshape(width, height).T


#: Pixels, about, that are drawn in one step.
STEP_PIXELS = 1 << 20


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the item, place within it) of each of n[0] + n[1] + ... places."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _frame(flat) -> float:
    """Pixels of the rectangle around a polygon."""
    return (np.ptp(flat[::2]) + 1) * (np.ptp(flat[1::2]) + 1) if flat is not None and len(flat) >= 6 else 0


def polygon_pixels(of: np.ndarray, flats: list, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(note, row, col) of the pixels of all polygons at once, as ``fill_polygon`` fills each; polygon i belongs to note of[i]."""
    n = np.array([len(f) // 2 for f in flats], np.int64)
    x, y = np.concatenate([np.asarray(f, float)[: len(f) // 2 * 2].reshape(-1, 2) for f in flats]).T
    if not np.isfinite(x + y).all():
        raise ValueError("a polygon's point is no number")
    own, k = _spread(n)
    following = np.arange(len(x)) + np.where(k == n[own] - 1, 1 - n[own], 1)
    x2, y2 = x[following], y[following]
    # rows whose centre line an edge crosses; rows beyond the image are left out
    high = height[of][own]
    first = np.clip(np.ceil(np.minimum(y, y2) - 0.5), 0, high).astype(np.int64)
    end = np.clip(np.ceil(np.maximum(y, y2) - 0.5), 0, high).astype(np.int64)
    edge, k = _spread(np.maximum(end - first, 0))
    row = first[edge] + k
    cross = x[edge] + (row + 0.5 - y[edge]) * (x2[edge] - x[edge]) / (y2[edge] - y[edge])
    order = np.lexsort((cross, row, own[edge]))  # crossings of a polygon's row stand together, and are even in number
    polygon, row, cross = own[edge][order][::2], row[order][::2], cross[order]
    wide = width[of][polygon]
    left, right = (np.clip(np.ceil(c - 0.5), 0, wide).astype(np.int64) for c in (cross[::2], cross[1::2]))
    span, k = _spread(np.maximum(right - left, 0))
    return of[polygon[span]], row[span], left[span] + k


def run_pixels(of: np.ndarray, runs: list, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(note, row, col) of the pixels of all run lengths at once, as ``fill_runs`` fills each."""
    n = np.array([len(r) for r in runs], np.int64)
    lengths = np.concatenate([np.asarray(r, np.int64) for r in runs])
    own, k = _spread(n)
    ends = np.cumsum(lengths)
    ends -= np.concatenate(([0], ends))[np.cumsum(n) - n][own]  # counted from the note's first run
    size = (height * width)[of][own]
    first, end = np.minimum(ends - lengths, size), np.minimum(ends, size)
    run, k = _spread(np.where(k % 2 == 1, end - first, 0))
    place, note = first[run] + k, of[own[run]]
    return note, place % height[note], place // height[note]


def rasterise(notes: DataFrame) -> DataFrame:
    """(image, row, col, label) of annotations (image, label, segmentation, runs, height, width); parts of one unite.

    An annotation has polygons or runs; one that covers no pixel gives no row.  Annotations are drawn many at a time.
    """
    notes = notes if "runs" in notes.columns else notes.withColumn("runs", F.lit(None).cast("array<int>"))

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        height, width = x["height"].to_numpy(np.int64), x["width"].to_numpy(np.int64)
        polygons = [(i, f) for i, s in enumerate(x["segmentation"]) if s is not None for f in s if f is not None and len(f) >= 6]
        runs = [(i, r) for i, r in enumerate(x["runs"]) if r is not None and len(r)]
        parts = [f(np.array([i for i, _ in p], np.int64), [v for _, v in p], height, width) for f, p in ((polygon_pixels, polygons), (run_pixels, runs)) if p]
        if not parts:
            return x.iloc[:0][["image", "label"]].assign(row=0, col=0)
        note, row, col = (np.concatenate(c) for c in zip(*parts, strict=True))
        wide = int(width.max())
        size = int(height.max()) * wide
        key = np.unique(note * size + row * wide + col)
        note, place = key // size, key % size
        return pd.DataFrame({"image": x["image"].to_numpy()[note], "row": place // wide, "col": place % wide, "label": x["label"].to_numpy()[note]})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [sum(r[1::2]) if r is not None else sum(min(h * w, _frame(f)) for f in s) if s is not None else 0 for s, r, h, w in zip(batch["segmentation"], batch["runs"], batch["height"], batch["width"], strict=True)]
            for _, part in batch.groupby(np.cumsum(drawn) // STEP_PIXELS, sort=False):
                yield draw(part)[["image", "row", "col", "label"]]

    # notes are few bytes and many pixels, so that the parts of a small file would be too few tasks
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = notes.select("image", "label", "segmentation", "runs", "height", "width").repartition(parts, "image", "label")
    return dealt.mapInPandas(task, "image string, row int, col int, label long")


def load_parameters(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(report, selected parameters) of a JSON file; a missing section or key is an error.  The report's model has a usual name if it gives none."""
    report = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    selected = report.get("selected_parameters")
    if selected is None:
        raise KeyError("selected_parameters")
    if missing := [k for k in PARAMETERS if k not in selected]:
        raise KeyError(f"missing parameters: {missing}")
    return {"model": DEFAULT_MODEL} | report, selected


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def validate_cluster_labels(df: DataFrame, label: str) -> list[int]:
    found = sorted((r[0] for r in df.select(label).distinct().collect()), key=lambda x: (x is None, x))
    if None in found or len(found) < 2 or found != list(range(1, len(found) + 1)):
        raise ValueError(f"cluster labels must be 1 ... n: {found}")
    return found


def mask_cache(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached, to do): masks of the same configuration and shape count."""
    keys = ["image", "config_id", "height", "width"]
    known = masks.select(*keys).distinct()
    return images.join(known, keys, "left_semi"), images.join(known, keys, "left_anti")


def write_table(df: DataFrame, path: str, *order, csv: bool = False, index: str | None = None) -> None:
    """Parquet, or CSV with a header; sorted with nulls last if asked; ``index`` becomes the first column."""
    out = df.select(index, *(c for c in df.columns if c != index)) if index else df
    out = out.orderBy(*(F.asc_nulls_last(c) for c in order)) if order else out
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


#: Bytes that are copied at a time.
_COPIED = 8 << 20


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of the rows of ``lines`` (a column, sorted), in their order.

    Tasks write the sorted parts, and one more copies them behind each other, a few megabytes at a time: none sorts or holds the whole.
    """
    from pyarrow import fs

    parts = f"{path.rstrip('/')}-parts"
    lines.write.text(parts)
    names = lines.sparkSession.createDataFrame([(parts,)], "parts string")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["parts"]:
                open_, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                to = path if "://" not in path else fs.FileSystem.from_uri(path)[1]
                open_.create_dir(to, recursive=True)
                found = [f.path for f in open_.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")]
                draft = f"{to}/_lines-{uuid.uuid4().hex}"  # readers pass over it; a task that is lost leaves no half of a file
                with open_.open_output_stream(draft) as out:
                    for name in sorted(found):
                        with open_.open_input_stream(name, compression=None) as part:
                            while block := part.read(_COPIED):
                                out.write(block)
                open_.move(draft, f"{to}/lines.txt")
            yield pd.DataFrame({"parts": batch["parts"]})

    names.mapInPandas(task, "parts string").collect()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A JSON document of a run's parameters and counts, as one line of text."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model, path: str, about: dict) -> None:
    """A fitted pipeline and, beside it, what it was made from (columns, classes, seed ...)."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    write_manifest(spark, f"{path}/about", about)


def load_model(path: str) -> tuple:
    """(fitted pipeline, what it was made from)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), read_manifest(SparkSession.active(), f"{path}/about")
