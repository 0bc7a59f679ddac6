"""A trusted quad carried along a series of projective maps, past those that can't be right."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import polygons

#: Largest step and total move of a corner, and the range of the area against the reference's.
MAX_STEP, MAX_TOTAL, AREAS = 0.08, 0.16, (0.70, 1.40)
#: Corners may come to lie so far outside of the unit square, whose edge they are then put on; smaller quads are no quads.
BEYOND, MIN_AREA = 0.05, 0.005
TRACKED, NO_MAP, NO_QUAD, STEP_TOO_LARGE, TOTAL_TOO_LARGE, AREA_TOO_LARGE = range(6)
#: Names of the statuses, in their order.
STATUSES = ("tracked", "unavailable", "invalid_transform", "step_shift_too_large", "total_shift_too_large", "area_change_too_large")


#: Rows of a chunk, whose entities are carried along side by side.
CHUNK_ROWS = 100_000


def _moved(quads: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quads (n, 8) under maps of nine numbers (n, 9), and which of them are quads still."""
    x, y = quads[:, 0::2], quads[:, 1::2]
    m = m[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        z = m[:, 6] * x + m[:, 7] * y + m[:, 8]
        out = np.stack([(m[:, 0] * x + m[:, 1] * y + m[:, 2]) / z, (m[:, 3] * x + m[:, 4] * y + m[:, 5]) / z], 2).reshape(len(quads), 8)
        inside = ((out >= -BEYOND) & (out <= 1 + BEYOND)).all(1)
        out = np.minimum(1.0, np.maximum(0.0, out))
        # Convex, its corners running clockwise on a page whose y grows downward.
        edge = np.roll(out.reshape(-1, 4, 2), -1, 1) - out.reshape(-1, 4, 2)
        after = np.roll(edge, -1, 1)
        turns = (edge[..., 0] * after[..., 1] - edge[..., 1] * after[..., 0] > 0).all(1)
        return out, inside & turns & (polygons.quad_areas(out) >= MIN_AREA)


def _farthest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(d[:, 0::2] * d[:, 0::2] + d[:, 1::2] * d[:, 1::2]).max(1)


def tracking_chain(steps: DataFrame, quads: DataFrame, max_step: float = MAX_STEP, max_total: float = MAX_TOTAL, areas: tuple[float, float] = AREAS) -> DataFrame:
    """The trusted quad after every step: ``entity, idx, status, step_shift, total_shift, area_ratio, x0, y0 .. x3, y3``.

    ``steps`` has ``entity, idx`` and the map from the step before, ``m0 .. m8``
    in row order over the unit square, null where none was found; ``quads`` has
    the reference quad of each entity. A step moves the trusted quad, unless
    there is no map, what it gives is no quad, a corner moves more than
    ``max_step`` or lies more than ``max_total`` from its reference, or the
    area is out of range: then the last trusted quad stays and the next step
    begins from it. Shifts are those of the quad tried, null where there is
    none. Statuses are named in ``STATUSES``.

    One stream per entity; its state is two quads. A task takes chunks of its
    stream and carries all entities of a chunk along side by side; what a chunk
    cuts goes on in the next. Entities without a reference quad give no rows.
    """
    corners = [f"{axis}{i}" for i in range(4) for axis in "xy"]
    maps = [f"m{k}" for k in range(9)]
    none = F.lit(None).cast("double")
    # The reference comes first in its entity's stream.
    first = quads.select("entity", F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("kind"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(corners)], none.alias("v8"))
    rest = steps.select("entity", F.col("idx").cast("long").alias("idx"), F.lit(1).alias("kind"), *[F.col(m).cast("double").alias(f"v{k}") for k, m in enumerate(maps)])
    stream = first.unionByName(rest)

    def step(quads: np.ndarray, reference: np.ndarray, maps: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Status, shifts and ratio of the next step of each quad, which is changed in place where it is tracked."""
        moved, fine = _moved(quads, maps)
        fine &= known
        near, far, stayed = _farthest(moved, quads), _farthest(moved, reference), _farthest(quads, reference)
        ratio = polygons.quad_areas(moved) / np.maximum(polygons.quad_areas(reference), 1e-6)
        tests = [~known, ~fine, near > max_step, far > max_total, ~((areas[0] <= ratio) & (ratio <= areas[1]))]
        status = np.select(tests, [NO_MAP, NO_QUAD, STEP_TOO_LARGE, TOTAL_TOO_LARGE, AREA_TOO_LARGE], TRACKED)
        quads[status == TRACKED] = moved[status == TRACKED]
        return status, np.where(fine, near, np.nan), np.where(fine, far, stayed), np.where(fine, ratio, np.nan)

    def chunk(rows: pa.Table, carried: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
        """The steps of sorted rows, and the last entity with its reference and its trusted quad."""
        entity = rows["entity"].combine_chunks()
        other = pc.fill_null(pc.not_equal(entity[1:], entity[:-1]), True).to_numpy(zero_copy_only=False) if len(entity) > 1 else np.empty(0, bool)
        start = np.concatenate(([0], np.flatnonzero(other) + 1))
        end = np.append(start[1:], len(entity))
        v = np.stack([rows[f"v{k}"].to_numpy() for k in range(9)], 1)
        known = np.logical_and.reduce([rows[f"v{k}"].is_valid().to_numpy() for k in range(9)])
        first = start + np.add.reduceat(rows["kind"].to_numpy() == 0, start, dtype=np.int64)
        reference, has = v[np.maximum(first - 1, 0), :8], first > start
        quads = reference.copy()
        if carried and not has[0] and entity[0].as_py() == carried[0]:
            reference[0], quads[0], has[0] = carried[1], carried[2], True
        out = np.full((len(entity), 12), np.nan)
        # Longest first, so those that still have steps stand in front.
        order = np.argsort(-np.where(has, end - first, 0), kind="stable")
        ref, at, many = reference[order], quads[order], np.where(has, end - first, 0)[order]
        for k in range(int(many.max(initial=0))):
            n = int(np.searchsorted(-many, -k, side="left"))
            row = first[order[:n]] + k
            found = step(at[:n], ref[:n], v[row], known[row])
            out[row] = np.column_stack([*found, at[:n]])
        quads[order] = at
        given = np.flatnonzero(~np.isnan(out[:, 0]))
        columns = [pa.array(out[given, k], from_pandas=True) for k in range(1, 12)]
        batch = pa.RecordBatch.from_arrays([entity.take(pa.array(given)), rows["idx"].combine_chunks().take(pa.array(given)), pa.array(out[given, 0].astype(np.int32)), *columns], names)
        return batch, (entity[-1].as_py(), reference[-1], quads[-1]) if has[-1] else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, carried = [], 0, None
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                out, carried = chunk(pa.Table.from_batches(held), carried)
                held, n = [], 0
                yield out
        if n:
            yield chunk(pa.Table.from_batches(held), carried)[0]

    numbers = ["step_shift", "total_shift", "area_ratio", *corners]
    names = ["entity", "idx", "status", *numbers]
    out = StructType([StructField("entity", stream.schema["entity"].dataType), *StructType.fromDDL("idx long, status int, " + ", ".join(f"{c} double" for c in numbers)).fields])
    columns = ["entity", "kind", "idx", *[f"v{k}" for k in range(9)]]
    folded = stream.select(*columns).repartition("entity").sortWithinPartitions(*columns).mapInArrow(run, out)
    return folded.withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("status") + 1))
