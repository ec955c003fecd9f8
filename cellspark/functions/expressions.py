"""Column expressions: null handling, ratios, shapes, file names, reasons.

Missing numbers are NULL throughout; ``clean`` turns NaN into NULL where data come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of an image's file name, and the feature sets used downstream.
FILE_NAME = r"^([^_]+)_([^_]+)_([A-Za-z]\d+)_(\d+)_(\d+d\d+h\d+m)_(\d+)\.tif$"
IOU_THRESHOLD = 0.50
NEIGHBOUR_RADIUS = 50.0
CROP_PADDING = 30


def clean(df: DataFrame) -> DataFrame:
    """NaN in any double or float column becomes NULL."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def finite(*columns: str | Column) -> Column:
    """All columns are numbers: not NULL, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        out = out & F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def iou(overlap: Column, area_a: Column, area_b: Column) -> Column:
    return ratio(overlap, area_a + area_b - overlap)


def truthy(c: Column) -> Column:
    """Booleans that a text file turned into strings; NULL is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def positive_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where undefined."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def aspect_ratio(major: Column, minor: Column) -> Column:
    return F.when(minor > 0, major / minor)


def circularity(area: Column, perimeter: Column) -> Column:
    """May exceed 1: it is not clamped."""
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter))


def edge_distance(row: Column, col: Column, height: Column, width: Column) -> Column:
    return F.least(row, col, height - 1 - row, width - 1 - col)


def touches_border(min_row: Column, min_col: Column, max_row: Column, max_col: Column, height: Column, width: Column) -> Column:
    """Bounding boxes are half open."""
    return (min_row <= 0) | (min_col <= 0) | (max_row >= height) | (max_col >= width)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (value - mean) / std)


def density(cells: Column, area: Column) -> Column:
    """Cells per 100,000 pixels."""
    return F.try_divide(cells.cast("double"), area) * 100_000


def add_filename_metadata(df: DataFrame, name: str = "image") -> DataFrame:
    """cell_line, modality, well, location, elapsed_time, elapsed_hours and crop; all NULL where the name doesn't fit."""
    ok = F.col(name).rlike(FILE_NAME)
    part = lambda i: F.when(ok, F.regexp_extract(name, FILE_NAME, i))
    time = part(5)
    number = lambda i: F.regexp_extract(time, r"^(\d+)d(\d+)h(\d+)m$", i).try_cast("double")
    return df.withColumns({
        "cell_line": part(1), "modality": part(2), "well": part(3), "location": part(4).try_cast("int"), "elapsed_time": time,
        "elapsed_hours": number(1) * 24 + number(2) + number(3) / 60, "crop": part(6).try_cast("int"),
    })


def metadata_for_line(df: DataFrame, line: Column, name: str = "image") -> DataFrame:
    """The same, but the line that was asked for stands whatever the name says."""
    return add_filename_metadata(df, name).withColumn("cell_line", line)


def with_literals(df: DataFrame, model_name: str, parameters: dict, **metadata) -> DataFrame:
    """``df`` with metadata, the model's name and its parameters (``cellpose_*``) on each row; None gives NULL."""
    kinds = {"diameter": "int", "cellprob_threshold": "double", "flow_threshold": "double", "min_size": "int"}
    more = {k: F.lit(v) for k, v in metadata.items()} | {"model_name": F.lit(model_name)}
    return df.withColumns(more | {f"cellpose_{k}": F.lit(parameters[k]).cast(kind) for k, kind in kinds.items()})


def count_ratios(truth: Column, predicted: Column, missed: Column) -> dict[str, Column]:
    """prediction_to_truth_ratio and false_negative_rate; NULL where there is no truth."""
    return {"prediction_to_truth_ratio": F.try_divide(predicted.cast("double"), truth.cast("double")), "false_negative_rate": F.try_divide(missed.cast("double"), truth.cast("double"))}


def cluster_label(cluster: Column) -> Column:
    return F.concat(F.lit("Morphology cluster "), cluster.cast("string"))


def share_of_total(count: str) -> Column:
    """The row's part of the sum over all rows of a small aggregate."""
    return F.col(count) / F.sum(count).over(Window.partitionBy())


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def config_id(diameter: Column, cellprob: Column, flow: Column, min_size: Column) -> Column:
    return F.concat(F.lit("diameter_"), F.coalesce(diameter.cast("string"), F.lit("native")), F.lit("__cellprob_"), F.format_string("%+.1f", cellprob), F.lit("__flow_"), F.format_string("%.1f", flow), F.lit("__minsize_"), min_size.cast("string"))


def reasons(**flags: Column) -> Column:
    """Names of the flags that hold, in the order given; ``included`` if none."""
    named = F.concat_ws(";", *(F.when(flag, F.lit(name)) for name, flag in flags.items()))
    return F.when(named == "", "included").otherwise(named)


def group_key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def crop_bounds(min_row, min_col, max_row, max_col, height, width, padding: int = CROP_PADDING) -> Column:
    return F.struct(F.greatest(F.lit(0), min_row - padding).alias("row_from"), F.least(height, max_row + padding).alias("row_to"), F.greatest(F.lit(0), min_col - padding).alias("col_from"), F.least(width, max_col + padding).alias("col_to"))


def polygon_points(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] to an array of (x, y); a last odd number is dropped."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y"))))
