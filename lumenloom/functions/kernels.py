"""Numeric kernels on array columns of doubles, as native higher-order functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: the optimizer would put a plain expression into every place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(values: Column) -> Column:
    """Whether every value is a finite number; null for a null array, true for an empty one."""
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def per_channel(values: Column, size: int, fn: Callable[[Column, Column], Column]) -> Column:
    """fn(value, number of its channel from 0), for channels of size values that follow each other."""
    return F.transform(values, lambda x, i: fn(x, F.floor(i / size).cast("int")))


def _constants(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalise(values: Column, means: Sequence[float], stds: Sequence[float], size: int) -> Column:
    m, s = _constants(means), _constants(stds)
    return per_channel(values, size, lambda x, c: (x - F.get(m, c)) / F.get(s, c))


def denormalise(values: Column, means: Sequence[float], stds: Sequence[float], size: int) -> Column:
    m, s = _constants(means), _constants(stds)
    return per_channel(values, size, lambda x, c: x * F.get(s, c) + F.get(m, c))


def pixels_to_unit(values: Column) -> Column:
    """0..255 to -1..1."""
    return F.transform(values, lambda x: x / 127.5 - 1)


def unit_to_share(values: Column) -> Column:
    """-1..1 to 0..1, clamped."""
    return F.transform(values, lambda x: F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0)))


def to_bytes(values: Column) -> Column:
    """0..255; values are taken as shares of 255 only if none is above 1."""
    scale = F.when(F.array_max(values) <= 1.0, F.lit(255.0)).otherwise(F.lit(1.0))
    return F.transform(values, lambda x: F.least(F.greatest(x * scale, F.lit(0.0)), F.lit(255.0)).cast("int"))


def resolution_shift(height: Column, width: Column, patch: int = 2) -> Column:
    """1 up to 256 patches, then growing with the logarithm of their number up to 3 at 4096."""
    patches = height * width / float(patch * patch)
    grown = 1 + 2 * F.least(F.ln(patches / 256.0) / math.log(16.0), F.lit(1.0))
    return F.when(patches <= 256, F.lit(1.0)).otherwise(grown)


def shift_time(t: Column, shift: Column) -> Column:
    return shift * t / (1 + (shift - 1) * t)


def shifted_schedule(start: float, end: float, steps: int, shift: Column) -> Column:
    """steps + 1 shifted times from start to end."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: shift_time(F.lit(start) + (end - start) * i / float(steps), shift))


def learning_rate(step: Column, warmup: int, steps: int, lowest: float, base: float, start: float = 1e-6) -> Column:
    """Linear from start to base over the warm-up, then a half cosine down to lowest."""
    if base <= 0:
        raise ValueError("base must be positive")
    warmup = max(warmup, 0)
    steps = max(steps, warmup + 1)
    low, first = min(lowest, base) / base, min(start, base) / base
    rising = first + (1 - first) * (step / float(max(1, warmup)))
    done = F.least(F.greatest((step - warmup) / float(max(1, steps - warmup)), F.lit(0.0)), F.lit(1.0))
    falling = low + (1 - low) * 0.5 * (1 + F.cos(math.pi * done))
    return base * F.when(step < warmup, rising).otherwise(falling)


def mix_linear(z0: Column, z1: Column, t: Column) -> Column:
    """The straight path from z0 to z1."""
    return F.zip_with(z0, z1, lambda a, b: (1 - t) * a + t * b)


def difference(z1: Column, z0: Column) -> Column:
    """The velocity of the straight path."""
    return F.zip_with(z1, z0, lambda a, b: a - b)


def log_mean_coefficient(t: Column, low: float = 0.1, high: float = 20.0) -> Column:
    return -t * t * (high - low) / 4.0 - t * low / 2.0


def mix_preserving(z0: Column, z1: Column, t: Column, low: float = 0.1, high: float = 20.0) -> Column:
    """The variance-preserving path; z0 is the noise."""
    c = log_mean_coefficient(t, low, high)
    return let(F.struct(F.exp(c).alias("data"), F.sqrt(1 - F.exp(2 * c)).alias("noise")), lambda k: F.zip_with(z0, z1, lambda a, b: k["data"] * b + k["noise"] * a))


def preserving_velocity(z0: Column, z1: Column, t: Column, low: float = 0.1, high: float = 20.0) -> Column:
    c, beta = log_mean_coefficient(t, low, high), low + t * (high - low)
    var = 1 - F.exp(2 * c)
    parts = F.struct((-0.5 * beta * F.exp(c)).alias("data"), (beta * (1 - var) / (2 * F.sqrt(var) + 1e-6)).alias("noise"))
    return let(parts, lambda k: F.zip_with(z0, z1, lambda a, b: k["data"] * b + k["noise"] * a))


def mean_square(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def score_loss(out: Column, z0: Column, std: Column) -> Column:
    return mean(F.zip_with(out, z0, lambda o, z: (o * std + z) * (o * std + z)))


def euler(x: Column, v: Column, dt: Column | float) -> Column:
    return F.zip_with(x, v, lambda a, b: a + b * dt)


def heun(x: Column, v1: Column, v2: Column, dt: Column | float) -> Column:
    both = F.zip_with(v1, v2, lambda a, b: a + b)
    return F.zip_with(x, both, lambda a, b: a + 0.5 * b * dt)


def euler_maruyama(x: Column, f: Column, s: Column, g: Column, dt: float, noise: Column) -> Column:
    """One step of the reverse stochastic equation, with the noise given."""
    drift = F.zip_with(f, s, lambda a, b: (a - g * g * b) * dt)
    moved = F.zip_with(x, drift, lambda a, b: a + b)
    return F.zip_with(moved, noise, lambda a, n: a + g * math.sqrt(abs(dt)) * n)


def flow_step(x: Column, s: Column, t: Column, dt: float, low: float = 0.1, high: float = 20.0) -> Column:
    """One step of the probability-flow equation of the variance-preserving path."""
    beta = low + t * (high - low)
    return F.zip_with(x, s, lambda a, b: a - 0.5 * beta * (a + b) * dt)


def solve(x: Column, field: Callable[[Column, Column], Column], times: Column, method: str = "euler") -> Column:
    """x after all steps between the given times, for a field(x, t) that is an expression; methods: euler, heun."""
    if method not in ("euler", "heun"):
        raise ValueError(f"unknown method {method!r}")

    def step(state: Column, a: Column, b: Column) -> Column:
        def move(v: Column, dt: Column) -> Column:
            if method == "euler":
                return euler(state, v, dt)
            return heun(state, v, field(euler(state, v, dt), b), dt)

        return let(b - a, lambda dt: let(field(state, a), lambda v: move(v, dt)))

    spans = F.transform(F.sequence(F.lit(0), F.size(times) - 2), lambda i: F.struct(F.get(times, i).alias("a"), F.get(times, i + 1).alias("b")))
    return F.aggregate(spans, x, lambda state, s: step(state, s["a"], s["b"]))


def solved(
    df: DataFrame, column: str, field: Callable[[np.ndarray, float], np.ndarray], times: Sequence[float], method: str | Callable = "euler", intermediates: bool = False, callback: Callable[[int, int], None] | None = None, name: str = "solved"
) -> DataFrame:
    """df with the arrays of a column after all steps between the given times; with intermediates, the array of all states from the first on.

    field(x, t) gives the velocities of a matrix of rows, as a model does; a batch of rows is one matrix. method is euler, heun, or a function step(x, t, dt, field).
    callback(step, steps) is called in the task before each step of a batch. Null arrays stay null; arrays of a batch may differ in length.
    """

    def euler_step(x, t, dt, field):
        return x + dt * field(x, t)

    def heun_step(x, t, dt, field):
        v = field(x, t)
        return x + 0.5 * dt * (v + field(x + dt * v, t + dt))

    steps = {"euler": euler_step, "heun": heun_step}
    if not callable(method) and method not in steps:
        raise ValueError(f"unknown method {method!r}")
    step = method if callable(method) else steps[method]
    kind = T.ArrayType(T.ArrayType(T.DoubleType())) if intermediates else T.ArrayType(T.DoubleType())
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
    spans = list(zip(times[:-1], times[1:], strict=True))

    def run(batches):
        for batch in batches:
            values = batch.column(column)
            sizes = np.where(values.is_null(), -1, np.diff(values.offsets.to_numpy()))
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            out: list = [None] * batch.num_rows
            for size in np.unique(sizes[sizes >= 0]):
                rows = np.flatnonzero(sizes == size)
                x = flat[starts[rows][:, None] + np.arange(size)]
                states = [x]
                for k, (a, b) in enumerate(spans, 1):
                    if callback:
                        callback(k, len(spans))
                    x = step(x, a, b - a, field)
                    states.append(x)
                made = np.stack(states, 1) if intermediates else x
                for row, value in zip(rows.tolist(), made.tolist(), strict=True):
                    out[row] = value
            kept = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.list_(pa.float64())) if intermediates else pa.list_(pa.float64()))], schema.names)

    return df.mapInArrow(run, schema)


def guided(cond: Column, uncond: Column, scale: float) -> Column:
    """Without condition plus scale times the difference; scales up to 1 leave the conditional result as it is."""
    return cond if scale <= 1 else F.zip_with(uncond, cond, lambda u, c: u + scale * (c - u))


def modulate(x: Column, shift: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, scale, lambda a, s: a * (1 + s)), shift, lambda a, s: a + s)


def masked_mean(values: Column, mask: Column) -> Column:
    return dot(values, mask) / F.greatest(total(mask), F.lit(1.0))


def masked_values(values: Column, mask: Column) -> Column:
    """The values whose mask is above 0."""
    pairs = F.filter(F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda p: p["m"] > 0)
    return F.transform(pairs, lambda p: p["v"])


def trimmed(sequence: Column, drop: int = 38, keep: int = 1024) -> Column:
    """Without the first drop items, of the rest at most keep; too short sequences become empty."""
    return F.slice(sequence, drop + 1, keep)


def padded(sequence: Column, size: Column, filler: Column) -> Column:
    return F.concat(sequence, F.array_repeat(filler, F.greatest(size - F.size(sequence), F.lit(0)).cast("int")))


def padding_mask(sequence: Column, size: Column) -> Column:
    """1 for each item of a sequence and 0 for each that padding to size adds."""
    n = F.size(sequence)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(size - n, F.lit(0)).cast("int")))


def progress(step: Column, steps: Column) -> Column:
    """How far a run has come: from 0.1 before the first step to 0.9 after the last."""
    return 0.1 + 0.8 * step / steps


def grid_shape(n: Column, rows: Column | None = None, columns: Column | None = None) -> Column:
    """struct(rows, columns) of a grid for n pictures: as many columns as given, or as rows need, or as a square needs."""
    square = F.ceil(F.sqrt(n))
    wide = columns if columns is not None else F.ceil(n / rows) if rows is not None else square
    return let(wide.cast("int"), lambda w: F.struct((rows if rows is not None and columns is None else F.ceil(n / w)).cast("int").alias("rows"), w.alias("columns")))


def sinusoids(t: Column, dims: int, period: float = 10000.0) -> Column:
    half = dims // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.exp(-math.log(period) * i / float(half)))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def rotary_angles(position: Column, dims: int, theta: float = 10000.0, scaling: str | None = None, factor: float = 1.0) -> Column:
    """The dims / 2 rotation angles of a position; scaling: linear or ntk."""
    if scaling == "linear":
        position = position / float(factor)
    elif scaling == "ntk":
        theta = theta * factor ** (dims / (dims - 2))
    return F.transform(F.sequence(F.lit(0), F.lit(dims // 2 - 1)), lambda i: position / F.pow(F.lit(float(theta)), 2 * i / float(dims)))


def rotate(values: Column, angles: Column) -> Column:
    """Each pair of values that follow each other, turned by its angle."""
    turned = F.transform(angles, lambda a, i: F.array(F.get(values, 2 * i) * F.cos(a) - F.get(values, 2 * i + 1) * F.sin(a), F.get(values, 2 * i) * F.sin(a) + F.get(values, 2 * i + 1) * F.cos(a)))
    return F.flatten(turned)


def patched(values: Column, rows: int, columns: int, channels: int, patch: int) -> Column:
    """From one image per channel to one list of (patch row, patch column, channel) per patch; the inverse of unpatched."""
    height, width = rows * patch, columns * patch

    def place(k: Column) -> Column:
        c, inner, token = k % channels, F.floor(k / channels) % (patch * patch), F.floor(k / (channels * patch * patch))
        y = F.floor(token / columns) * patch + F.floor(inner / patch)
        x = token % columns * patch + inner % patch
        return F.get(values, ((c * height + y) * width + x).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), place)


def unpatched(values: Column, rows: int, columns: int, channels: int, patch: int) -> Column:
    """From one list of (patch row, patch column, channel) per patch to one image per channel."""
    height, width = rows * patch, columns * patch

    def place(k: Column) -> Column:
        c, y, x = F.floor(k / (height * width)), F.floor(k / width) % height, k % width
        token = F.floor(y / patch) * columns + F.floor(x / patch)
        return F.get(values, (((token * patch + y % patch) * patch + x % patch) * channels + c).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), place)


def sane_side(pixels: Column) -> Column:
    """At least 64, and a multiple of 16."""
    return (F.floor(F.greatest(pixels, F.lit(64)) / 16) * 16).cast("int")


def caption_weights(tokens: Column, stage: float, least: float = 0.15, most: float = 0.8) -> Column:
    """Probabilities of captions by their token counts: early stages prefer short ones, late stages long ones."""
    alpha = min(max(stage, 0.0), 1.0)

    def weights(tokens: Column, mean_tokens: Column) -> Column:
        k = F.size(tokens)
        top = F.greatest(F.lit(least), F.least(F.lit(most), 1 - least * (k - 1)))
        scores = F.transform(tokens, lambda n: F.greatest(1 + 2.0 * (alpha - 0.5) * F.try_divide(n - mean_tokens, mean_tokens), F.lit(1e-6)))
        even = F.transform(tokens, lambda n: F.try_divide(F.lit(1.0), k))
        clipped = let(scores, lambda s: let(total(s), lambda all_s: F.transform(s, lambda x: F.least(F.greatest(F.try_divide(x, all_s), F.lit(least)), top))))
        shared = let(clipped, lambda c: let(total(c), lambda all_c: F.transform(c, lambda p: F.try_divide(p, all_c))))
        return F.when((mean_tokens == 0) | (k == 1), even).otherwise(shared)

    return let(tokens, lambda t: let(mean(t), lambda m: weights(t, m)))


def pick(weights: Column, u: Column) -> Column:
    """The first index (from 0) whose cumulative weight exceeds u; the last one if rounding leaves none."""
    return let(F.struct(weights.alias("w"), u.alias("u")), lambda x: _pick(x["w"], x["u"]))


def _pick(weights: Column, u: Column) -> Column:
    state = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit")),
        lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["hit"] < 0) & (u < a["sum"] + w), a["i"]).otherwise(a["hit"]).alias("hit")),
    )
    return F.when(state["hit"] < 0, F.size(weights) - 1).otherwise(state["hit"])
