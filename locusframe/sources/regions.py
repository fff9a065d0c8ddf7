"""Region files and processing records beside data files, read as tables.

Files are read by Spark from wherever it can read; each is parsed in the task
that has it, and one that can't be read becomes a row that says why.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # files in JSON, which is YAML as well, are read without it
    yaml = None

#: Fixed keys of region files: where the points of a shape are, and its size in nm or in camera pixels.
POINTS = {"Polygon": "Vertices", "Circle": "Centers", "Rectangle": "Center-Axis-Points", "Square": "Centers"}
SIZES = {"Circle": ("Diameter (nm)", "Diameter"), "Rectangle": ("Width (nm)", "Width"), "Square": ("Side Length (nm)", "Side Length")}
LARGEST = 32 << 20
REGIONS = "file string, region int, shape string, closed boolean, xs array<double>, ys array<double>, radius double, error string"


def documents(content: bytes) -> list[Any]:
    """The documents of a YAML file, or of a JSON one."""
    text = content.decode("utf-8", "ignore")
    return list(yaml.safe_load_all(text)) if yaml is not None else [json.loads(text)]


def _pair(value: Any) -> tuple[float, float]:
    x, y = value
    return float(x), float(y)


def regions_of(content: bytes, pixel_nm: float | None) -> list[tuple[int, str, bool, list[float], list[float], float | None]]:
    """(number, shape, closed, xs, ys, radius) of the regions of a file, in camera pixels; corners, or the centre of a circle."""
    docs = documents(content)
    if len(docs) != 1 or not isinstance(docs[0], dict):
        raise ValueError(f"{len(docs)} documents; a region file is one mapping")
    doc = docs[0]
    shape = doc.get("Shape", "Circle" if "Centers" in doc and "Diameter" in doc else None)
    if shape not in POINTS:
        raise ValueError(f"no region file: shape {shape!r}")
    size = 0.0
    if shape in SIZES:
        in_nm, in_pixels = SIZES[shape]
        if in_nm in doc:
            if not pixel_nm or pixel_nm <= 0:
                raise ValueError(f"{in_nm} is given and no pixel size is known")
            size = float(doc[in_nm]) / pixel_nm
        elif in_pixels in doc:
            size = float(doc[in_pixels])
        else:
            raise ValueError(f"neither {in_nm} nor {in_pixels}")
    out = []
    for i, raw in enumerate(doc.get(POINTS[shape]) or []):
        closed, radius = True, None
        if shape == "Polygon":
            corners = [_pair(p) for p in raw or []]
            closed = len(corners) >= 3 and corners[0] == corners[-1]
            corners = corners[:-1] if closed else corners
        elif shape == "Rectangle":
            a, b = map(_pair, raw)
            length = math.hypot(b[0] - a[0], b[1] - a[1])
            # Half a width to either side of the axis; an axis without a length counts as upright.
            across = (0.5 * size * (b[1] - a[1]) / length, -0.5 * size * (b[0] - a[0]) / length) if length else (0.5 * size, 0.0)
            corners = [(p[0] + k * across[0], p[1] + k * across[1]) for p, k in ((a, -1), (a, 1), (b, 1), (b, -1))]
        elif shape == "Square":
            (x, y), h = _pair(raw), size / 2
            corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
        else:
            corners, radius = [_pair(raw)], size / 2
        out.append((i, shape, closed, [p[0] for p in corners], [p[1] for p in corners], radius))
    if not out:
        raise ValueError("no regions")
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length", "content")


def read_regions(spark: SparkSession, path: str, pixel_nm: float | None = None, pattern: str = "*.yaml") -> DataFrame:
    """The regions of all files of a folder: file, region, shape, closed, xs, ys, radius, error.

    Places are in camera pixels; ``pixel_nm`` converts sizes that are given
    in nm. A polygon whose last corner is not its first is not closed and
    holds nothing. A file that is none of regions, is broken or too large has
    one row with only its name and the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, length, content in batch.itertuples(index=False):
                try:
                    if length > LARGEST:
                        raise ValueError("too large for a region file")
                    rows += [(file, *r, None) for r in regions_of(content, pixel_nm)]
                except Exception as error:  # noqa: BLE001  whatever a parser raises is the file's row
                    rows.append((file, None, None, None, None, None, None, str(error)[:500] or type(error).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")]).astype({"region": "Int32", "closed": "boolean"})

    return _files(spark, path, pattern).mapInPandas(run, REGIONS)


def inside_regions(points: DataFrame, regions: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """(id, file, region) of ``points(id, x, y)``, in camera pixels, that lie in a closed region or within ``tolerance`` of its edge.

    Regions are spread over the grid cells of their boxes and meet the points
    there; ``cell`` should be about the size of a region. A circle's edge is
    outside of it.
    """
    usable = regions.where("closed and error is null")
    reach = F.coalesce("radius", F.lit(0.0)) + tolerance
    low = lambda c: F.floor((F.array_min(c) - reach) / cell)
    high = lambda c: F.floor((F.array_max(c) + reach) / cell)
    spread = usable.withColumn("cx", F.explode(F.sequence(low("xs"), high("xs")))).withColumn("cy", F.explode(F.sequence(low("ys"), high("ys"))))
    placed = points.select("id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    x, y = F.col("x"), F.col("y")
    sides = F.arrays_zip(F.col("xs").alias("ax"), F.col("ys").alias("ay"), F.concat(F.slice("xs", 2, F.size("xs")), F.slice("xs", 1, 1)).alias("bx"), F.concat(F.slice("ys", 2, F.size("ys")), F.slice("ys", 1, 1)).alias("by"))
    crosses = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"])
    odd = F.size(F.filter(sides, crosses)) % 2 == 1

    def away(s):
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        t = F.coalesce(F.try_divide((x - s["ax"]) * dx + (y - s["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - s["ax"] - t * dx, y - s["ay"] - t * dy)

    near = F.exists(sides, lambda s: away(s) <= tolerance) if tolerance > 0 else F.lit(False)
    in_circle = F.hypot(x - F.element_at("xs", 1), y - F.element_at("ys", 1)) < F.col("radius") + tolerance
    hit = F.when(F.col("shape") == "Circle", in_circle).otherwise(odd | near)
    return placed.join(spread, ["cx", "cy"]).where(hit).select("id", "file", "region")


def read_metadata(spark: SparkSession, path: str, pattern: str = "*.yaml") -> DataFrame:
    """(file, step, key, value, error): the records of the processing steps of each file, oldest first; values are JSON.

    A broken file has one row with the error, and one with the pixel size if a
    line of it still says so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, _, content in batch.itertuples(index=False):
                try:
                    steps = [d for d in documents(content) if isinstance(d, dict)]
                    rows += [(file, i, str(k), json.dumps(v, default=str), None) for i, d in enumerate(steps) for k, v in d.items()]
                except Exception as error:  # noqa: BLE001
                    rows.append((file, None, None, None, str(error)[:500] or type(error).__name__))
                    for line in content.decode("utf-8", "ignore").splitlines():
                        key, _, value = line.strip().partition(":")
                        if key == "Pixelsize":
                            try:
                                rows.append((file, 0, key, json.dumps(float(value)), None))
                            except ValueError:
                                continue
                            break
            yield pd.DataFrame(rows, columns=["file", "step", "key", "value", "error"]).astype({"step": "Int32"})

    return _files(spark, path, pattern).mapInPandas(run, "file string, step int, key string, value string, error string")


def newest(metadata: DataFrame, *keys: str) -> DataFrame:
    """One row for each file with the value of each key that the newest step has, as JSON; explicit nulls don't count."""
    used = metadata.where(F.col("key").isin(*keys) & (F.col("value") != "null"))
    return used.groupBy("file").agg(*(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("step"))).alias(k) for k in keys))


def pixel_sizes(metadata: DataFrame) -> DataFrame:
    """(file, pixel_nm) of the files that say so."""
    return newest(metadata, "Pixelsize").select("file", F.expr("try_cast(trim('\"' from Pixelsize) as double)").alias("pixel_nm")).where("pixel_nm is not null")
