"""Local explanations: perturbations, weighted ridge fits and importance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Perturbations per window, time segments, kernel width, ridge penalty.
PERTURBATIONS = 500
SEGMENTS = 4
KERNEL_WIDTH = 0.25
ALPHA = 1.0
BITS = 128  # of one digest


def perturbation_masks(
    windows: DataFrame,
    key: str,
    features: int,
    perturbations: int = PERTURBATIONS,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(key, *carry, perturbation, mask)``: a digest bit keeps or drops a feature.

    Feature *f* reads hex digit ``f // 4`` of the digest, bit ``f % 4``.
    Perturbation 0 keeps everything. Each window makes its own rows, without a
    join; the digest is read as 32-bit words so that all bits are plain shifts.
    """
    rows = windows.select(key, *carry, F.explode(F.sequence(F.lit(0), F.lit(perturbations - 1))).alias("perturbation"))
    for block in range(-(-features // BITS)):
        text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("perturbation").cast("string"), F.lit(str(block)))
        rows = rows.withColumn("_hex", F.md5(text))
        rows = rows.withColumns(
            {
                f"_w{4 * block + j}": F.conv(F.substring("_hex", 8 * j + 1, 8), 16, 10).cast("long")
                for j in range(4)
            }
        )

    def bit(f: int) -> Column:
        shift = (7 - f % 32 // 4) * 4 + f % 4
        kept = F.shiftright(F.col(f"_w{f // 32}"), shift).bitwiseAND(F.lit(1)).cast("int")
        return F.when(F.col("perturbation") == 0, 1).otherwise(kept)

    return rows.select(key, *carry, "perturbation", F.array(*[bit(f) for f in range(features)]).alias("mask"))


def kept_fraction(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, b: a + b) / F.size(mask)


def proximity(mask: Column, width: float = KERNEL_WIDTH) -> Column:
    """``exp(-d^2 / width^2)`` with ``d`` the masked share."""
    far = 1.0 - kept_fraction(mask)
    return F.exp(-(far * far) / F.lit(width * width))


def apply_mask(signal: Column, mask: Column, channels: int, samples: int, segments: int = SEGMENTS) -> Column:
    """Zero the masked segments of each channel; the last segment takes the rest.

    Works on whole segments (slices), not on single samples.
    """
    length = samples // segments

    def piece(c: int, s: int) -> Column:
        size = length if s < segments - 1 else samples - length * (segments - 1)
        kept = F.slice(F.get(signal, F.lit(c)), s * length + 1, size)
        silent = F.array_repeat(F.lit(0.0), size)
        return F.when(F.get(mask, F.lit(c * segments + s)) == 1, kept).otherwise(silent)

    return F.array(*[F.concat(*[piece(c, s) for s in range(segments)]) for c in range(channels)])


def digest_masks(key, features: int, perturbations: int, seed: int) -> np.ndarray:
    """The masks of :func:`perturbation_masks` for one window, inside a task."""
    blocks = -(-features // BITS)
    raw = b"".join(
        hashlib.md5(f"{seed}|{key}|{p}|{b}".encode()).digest() for p in range(perturbations) for b in range(blocks)
    )
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 4)[:, ::-1]
    masks = bits.reshape(perturbations, blocks * BITS)[:, :features].astype(np.float64)
    masks[0] = 1.0
    return masks


def weighted_ridge(x: np.ndarray, y: np.ndarray, weights: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Coefficients of a weighted ridge fit with an unpenalised intercept."""
    share = weights / weights.sum()
    xc, yc = x - share @ x, y - share @ y
    gram = (xc * weights[:, None]).T @ xc + alpha * np.eye(x.shape[1])
    return np.linalg.solve(gram, (xc * weights[:, None]).T @ yc)


def ridge_explanations(
    windows: DataFrame,
    key: str,
    logits: Callable[[np.ndarray], np.ndarray],
    signal: str = "signal",
    perturbations: int = PERTURBATIONS,
    segments: int = SEGMENTS,
    seed: int = 42,
    batch: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """``(key, logit, coefficients)``: a local linear model per window.

    ``logits`` maps ``(n, channels, samples)`` to ``n`` logits. A window is
    perturbed, scored and fitted inside one task, and only ``batch`` perturbed
    copies exist at a time. A window costs hundreds of model calls: ``tasks`` spreads
    the rows over that many tasks first; without it the input's partitions are kept.
    """
    schema = T.StructType(
        [
            windows.schema[key],
            T.StructField("logit", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )

    def explained(k, x: np.ndarray) -> tuple:
        channels, samples = x.shape
        masks = digest_masks(k, channels * segments, perturbations, seed)
        segment = np.minimum(np.arange(samples) // (samples // segments), segments - 1)
        scores = [
            logits(x * masks[i : i + batch].reshape(-1, channels, segments)[:, :, segment])
            for i in range(0, perturbations, batch)
        ]
        y = np.concatenate(scores)
        far = 1.0 - masks.mean(axis=1)
        fit = weighted_ridge(masks, y, np.exp(-(far**2) / KERNEL_WIDTH**2))
        return float(y[0]), fit.reshape(channels, segments).tolist()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column(0).to_pylist()
            traces = rows.column(1)
            fits = [
                explained(k, np.stack([c.values.to_numpy(zero_copy_only=False) for c in t]).astype(np.float64))
                for k, t in zip(keys, traces)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([f[0] for f in fits], type=pa.float64()),
                    pa.array([f[1] for f in fits], type=pa.list_(pa.list_(pa.float64()))),
                ],
                names=schema.names,
            )

    rows = windows.select(key, signal)
    return (rows.repartition(tasks, key) if tasks else rows).mapInArrow(explain, schema)


def channel_importance(values: Column) -> Column:
    """Summed absolute value over time, per channel."""
    return F.transform(values, lambda t: F.aggregate(t, F.lit(0.0), lambda a, v: a + F.abs(v)))


def top_channels(importance: Column, k: int) -> Column:
    """The ``k`` largest entries as ``(value, channel)``, ties by channel order."""
    pairs = F.transform(importance, lambda v, c: F.struct((-v).alias("neg"), c.alias("channel")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(best, lambda p: F.struct((-p["neg"]).alias("value"), p["channel"].alias("channel")))


def global_importance(values: DataFrame, column: str) -> DataFrame:
    """Mean absolute value per channel over windows and time, with its rank.

    Each window is reduced to one number per channel before the shuffle.
    """
    sums = values.select(
        F.posexplode(
            F.transform(
                column,
                lambda t: F.struct(
                    F.aggregate(t, F.lit(0.0), lambda a, v: a + F.abs(v)).alias("s"), F.size(t).alias("n")
                ),
            )
        ).alias("channel", "p")
    )
    table = sums.groupBy("channel").agg((F.sum("p.s") / F.sum("p.n")).alias("mean_abs"))
    ranked = table.agg(F.array_sort(F.collect_list(F.struct((-F.col("mean_abs")).alias("neg"), "channel"))).alias("r"))
    return ranked.select(F.posexplode("r").alias("_p", "e")).select(
        "e.channel", (-F.col("e.neg")).alias("mean_abs"), (F.col("_p") + 1).alias("rank")
    )


def explained_windows(windows: DataFrame, scores: DataFrame, key: Sequence[str]) -> DataFrame:
    """The explained windows' metadata with the model's probability."""
    return windows.join(scores, list(key))
