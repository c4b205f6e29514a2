"""Image redaction: pixels of low-priority classes are blacked out, pixelated or blurred.

The semantic classes come with the frame as a class map; which class must be hidden is a parameter.
Frames are independent of each other: no shuffle, one Arrow batch of frames at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Priority of each of the 20 classes, and the priority below which a pixel is hidden.
CLASS_PRIORITIES = (5, 8, 8, 4, 3, 2, 2, 6, 6, 1, 1, 0, 7, 9, 9, 9, 9, 9, 9, 7)
THRESHOLD = 7
GRID = 50
BOX = 50
MODES = ("blackout", "pixelate", "blur")


def hidden(class_id: Column, priorities: Sequence[int] = CLASS_PRIORITIES,
           threshold: int = THRESHOLD) -> Column:
    """True for classes whose pixels must be hidden."""
    return F.element_at(F.array(*[F.lit(p) for p in priorities]), class_id + 1) < threshold


def blackout(pixels: Column, classes: Column, priorities: Sequence[int] = CLASS_PRIORITIES,
             threshold: int = THRESHOLD) -> Column:
    """Array form of the black-out, without leaving the JVM."""
    return F.zip_with(pixels, classes,
                      lambda v, c: F.when(hidden(c, priorities, threshold), F.lit(0.0)).otherwise(v))


def frame_redaction(section: str, params: tuple) -> Column:
    """The registered PET for image payloads that carry no class map: nothing of them is kept."""
    (mode,) = params
    if mode != "blackout":
        raise ValueError(f"{mode!r} needs a class map; use redact_frames")
    size = F.length("image").cast("int")
    return F.unhex(F.repeat(F.lit("00"), size))


def class_redaction(section: str, params: tuple) -> Column:
    """The registered PET for frames that carry their class map: ``mode`` and, if not the usual, the cells of the grid
    or the pixels of the box per side. Readings have ``height, width, n_channels`` and ``class_map``, a byte per pixel."""
    mode, size = params[0], (params[1] if len(params) > 1 else GRID)
    if mode not in MODES:
        raise ValueError(f"unknown redaction mode {mode!r}; known: {', '.join(MODES)}")

    @F.pandas_udf(T.BinaryType())
    def redact(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, classes: pd.Series) -> pd.Series:
        out = []
        for frame, h, w, n, kinds in zip(data, height, width, channels, classes):
            if frame is None:
                out.append(None)
                continue
            pixels = np.frombuffer(frame, np.uint8).reshape(int(h), int(w), int(n)).astype(float)
            kinds = np.frombuffer(kinds, np.uint8).reshape(int(h), int(w))
            done = redact_array(pixels, kinds, mode, CLASS_PRIORITIES, THRESHOLD, (size, size), (size, size))
            out.append(np.rint(done).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)
    # Frames under another transformation do not enter Python.
    mine = F.col("pet_label") == "class_redaction" + "".join(map(str, params))
    return redact(F.when(mine, F.col("image")), *[F.when(mine, F.col(c)) for c in ("height", "width", "n_channels", "class_map")])


def block_means(pixels: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    """Each pixel replaced by the mean of its cell in a coarse grid; ``pixels`` is (h, w, channels)."""
    height, width = pixels.shape[:2]
    rows = np.arange(height) * min(grid[0], height) // height
    cols = np.arange(width) * min(grid[1], width) // width
    row_starts = np.flatnonzero(np.diff(rows, prepend=-1))
    col_starts = np.flatnonzero(np.diff(cols, prepend=-1))
    sums = np.add.reduceat(np.add.reduceat(pixels, row_starts, axis=0), col_starts, axis=1)
    counts = np.outer(np.bincount(rows), np.bincount(cols))[:, :, None]
    return (sums / counts)[rows][:, cols]


def box_means(pixels: np.ndarray, box: tuple[int, int]) -> np.ndarray:
    """Each pixel replaced by the mean of the box around it, cut at the frame's edge."""
    for axis, size in enumerate(box):
        length = pixels.shape[axis]
        at = np.arange(length)
        low = np.maximum(at - size // 2, 0)
        high = np.minimum(at + (size - 1 - size // 2), length - 1) + 1
        zero = np.zeros_like(np.take(pixels, [0], axis=axis))
        totals = np.concatenate([zero, np.cumsum(pixels, axis=axis)], axis=axis)
        shape = [1] * pixels.ndim
        shape[axis] = length
        pixels = ((np.take(totals, high, axis=axis) - np.take(totals, low, axis=axis))
                  / (high - low).reshape(shape))
    return pixels


def redact_array(pixels: np.ndarray, classes: np.ndarray, mode: str, priorities: Sequence[int],
                 threshold: int, grid: tuple[int, int], box: tuple[int, int]) -> np.ndarray:
    """Redact one frame (h, w, channels). A class map of another size is resampled to the nearest."""
    height, width = pixels.shape[:2]
    rows = np.arange(height) * classes.shape[0] // height
    cols = np.arange(width) * classes.shape[1] // width
    mask = np.asarray(priorities)[classes[rows][:, cols]] < threshold
    if mode == "blackout":
        layer = np.zeros_like(pixels)
    elif mode == "pixelate":
        layer = block_means(pixels, grid)
    elif mode == "blur":
        layer = box_means(pixels, box)
    else:
        raise ValueError(f"unknown redaction mode {mode!r}; known: {', '.join(MODES)}")
    return np.where(mask[:, :, None], layer, pixels)


def redact_pixels(mode: str, height: int, width: int,
                  priorities: Sequence[int] = CLASS_PRIORITIES, threshold: int = THRESHOLD,
                  grid: tuple[int, int] = (GRID, GRID), box: tuple[int, int] = (BOX, BOX)):
    """Column function ``(pixels, classes) -> array<double>`` for grey frames of one known size."""
    if mode not in MODES:
        raise ValueError(f"unknown redaction mode {mode!r}; known: {', '.join(MODES)}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def redact(pixels: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([
            redact_array(np.asarray(p, dtype=float).reshape(height, width, 1),
                         np.asarray(c, dtype=np.int64).reshape(height, width),
                         mode, priorities, threshold, grid, box).ravel()
            for p, c in zip(pixels, classes)])

    return redact


def redact_frames(frames: DataFrame, mode: str, priorities: Sequence[int] = CLASS_PRIORITIES,
                  threshold: int = THRESHOLD, grid: tuple[int, int] = (GRID, GRID),
                  box: tuple[int, int] = (BOX, BOX)) -> DataFrame:
    """Redact decoded byte frames as the Spark image source gives them.

    ``frames`` has ``height, width, n_channels, data`` (row-wise bytes) and ``class_height,
    class_width, classes`` (``array<int>``). Adds ``processed_data``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown redaction mode {mode!r}; known: {', '.join(MODES)}")
    schema = T.StructType([*frames.schema.fields, T.StructField("processed_data", T.BinaryType())])

    def redact(batches):
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (
                "height", "width", "n_channels", "data", "class_height", "class_width")]
            maps = batch.column("classes")  # one number per pixel: read the buffer, not a list
            numbers, at = maps.flatten().to_numpy(zero_copy_only=False), 0
            for height, width, channels, data, class_height, class_width in zip(*columns):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                size = class_height * class_width
                class_map, at = numbers[at:at + size].reshape(class_height, class_width), at + size
                out = redact_array(pixels.astype(float), class_map, mode, priorities, threshold,
                                   grid, box)
                done.append(np.rint(out).astype(np.uint8).tobytes())
            yield batch.append_column("processed_data", pa.array(done, pa.binary()))

    return frames.mapInArrow(redact, schema)
