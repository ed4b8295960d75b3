"""Logistic regression of all slices and seeds at once, by Newton steps on Gram matrices.

The rows of a slice are packed once into blocks of bounded size. A step joins the
blocks with the few numbers that stand for each slice's models, sums gradients and Gram
matrices (features x features) of every seed per task, then per slice, and solves there.
One Spark job per step serves every slice and seed; the driver sees how many slices
still move and nothing else. The seeds of a block share its centred columns: a seed's own
standardized ones are sums of these, so that its sums follow from theirs per slice.

The model is that of `models.logreg`: mean-imputed, standardized numbers, text as one
column per training level, nulls as the training mode, L2 strength 1/n without the
intercept. It agrees with Spark ML to the optimizer's tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import attach, melt
from ..session import materialize
from .fairness import PREFIX
from .models import MIN_ROWS, feature_frame
from .sampling import split_cells, stratified_splits

BLOCK_ROWS = 4096
MAX_WIDTH = 512
# Blocks a slice from which the first steps see a part of them.
MANY_BLOCKS = 48
STATE = "slice string, done boolean, rounds int, n binary, fill binary, shift binary, scale binary, w binary, center binary, unit binary, miss binary"


def _floats(raw, *dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(*dims)


def _levels(flat: DataFrame, cats: Sequence[str], width: int) -> list[tuple[str, str]]:
    """All (column, level) of the text features; more than the width allows is an error, so the list is bounded."""
    if not cats:
        return []
    long = melt(flat, [], {c: F.col(c) for c in cats}).where(F.col("value").isNotNull())
    found = long.distinct().limit(width + 1).collect()
    if len(found) > width:
        raise ValueError(f"more than {width} levels of text features; group rare ones first")
    return sorted((r["column"], r["value"]) for r in found)


def _texts(columns) -> dict[str, list[str]]:
    """The levels of each text feature; their columns follow those of the numbers in this order."""
    out: dict[str, list[str]] = {}
    for c, level in columns:
        if level is not None:
            out.setdefault(c, []).append(level)
    return out


def _pack(columns, tests: Sequence[str], prot: Sequence[str]):
    """One row per (slice, block): numbers, a column after the other, with NaN for missing; texts as numbers of their levels, -1 for missing; labels, test flags, keys."""
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(n, -1)
        codes = [pc.index_in(table.column(c), value_set=pa.array(levels, pa.string())).fill_null(-1).to_numpy() for c, levels in _texts(columns).items()]
        flags = np.stack([table.column(t).to_numpy(zero_copy_only=False) for t in tests]).astype(bool)
        out = {"slice": table.column("slice")[:1], "part": table.column("__part")[:1], "rows": pa.array([n], pa.int32())}
        for name, v in (("x", np.ascontiguousarray(x.T)), ("codes", np.array(codes, "<i2")), ("y", table.column("y_true").to_numpy().astype("<i4")),
                        ("test", np.packbits(flags, axis=1))):
            out[name] = pa.array([v.tobytes()], pa.binary())
        for name, c in (("keys", "__row"), *((p, p) for p in prot)):
            out[name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).cast(pa.string()).combine_chunks())
        return pa.table(out)
    return run


def blocks(slices: DataFrame, target: str, key: str, features: Sequence[str], seeds: Sequence[int], test_size: float,
           protected: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, str | None]]]:
    """(packed rows, columns of the matrix). A column is (feature, None) or (feature, level)."""
    protected = [p for p in protected if p in slices.columns]
    keep = ["slice", F.col(key).cast("string").alias("__row"), F.col(target).cast("int").cast("double").alias("y_true"),
            *[F.col(p).cast("string").alias(PREFIX + p) for p in protected]]
    flat, nums, cats = feature_frame(slices.where(F.col(target).isNotNull() & F.col("slice").isNotNull()), features, keep)
    cells = [f"__c{i}" for i in range(len(seeds))]
    flat = materialize(flat.withColumns(dict(zip(cells, split_cells("__row", seeds)))))
    columns = [(c, None) for c in nums] + _levels(flat, cats, MAX_WIDTH - len(nums))
    nan = F.lit(float("nan"))
    values, texts = [F.coalesce(F.col(c), nan) for c in nums], list(_texts(columns))
    size = flat.groupBy("slice").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") >= MIN_ROWS)
    tests = [f"__t{i}" for i in range(len(seeds))]
    # the flags are columns of the rows themselves, so that all seeds share one scan and need no join
    rows = stratified_splits(attach(flat, size, ["slice"]), "y_true", "__row", seeds, tests, test_size, ["slice"], cells=cells)
    rows = rows.withColumn("x", F.array(*values).cast("array<double>"))
    # a block gets BLOCK_ROWS rows on average, whatever the size of its slice
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__row"), F.ceil(F.col("__rows") / BLOCK_ROWS)))
    prot = [PREFIX + p for p in protected]
    out = rows.select("slice", "__part", "__row", "y_true", "x", *texts, *tests, *prot).groupBy("slice", "__part").applyInArrow(
        _pack(columns, tests, prot), "slice string, part long, rows int, x binary, codes binary, y binary, test binary, keys array<string>" + "".join(f", `{p}` array<string>" for p in prot))
    return materialize(out), columns


def _batches_of(batches) -> Iterator[dict]:
    """Rows as dictionaries; binary cells are not copied, lists stay Arrow arrays."""
    for b in batches:
        cells = [(f.name, b.column(i), "as_buffer" if pa.types.is_binary(f.type) else "values" if pa.types.is_list(f.type) else "as_py")
                 for i, f in enumerate(b.schema)]
        for i in range(b.num_rows):
            row = {name: (c[i], how) for name, c, how in cells}
            yield {name: v.as_py() if how == "as_py" else v.values if how == "values" else v.as_buffer() for name, (v, how) in row.items()}


def _matrix(row: dict, columns, k: int):
    """The block's matrix, a column after the other, with NaN for missing; labels; 1 where a row trains a seed's model."""
    n, texts = row["rows"], _texts(columns)
    at = len(columns) - sum(map(len, texts.values()))
    x = np.empty((len(columns), n))
    x[:at] = _floats(row["x"], at, n)
    for code, levels in zip(np.frombuffer(row["codes"], "<i2").reshape(len(texts), n), texts.values()):
        x[at:at + len(levels)] = code == np.arange(len(levels))[:, None]
        x[at:at + len(levels), code < 0] = np.nan
        at += len(levels)
    test = np.unpackbits(np.frombuffer(row["test"], "u1").reshape(k, -1), axis=1, count=n)
    return x, np.frombuffer(row["y"], "<i4").astype(float), 1.0 - test


def _sums(work, columns, k: int):
    """Per task and slice: the sum of what `work` gives for each block."""
    def run(batches):
        held: dict[str, np.ndarray] = {}
        for row in _batches_of(batches):
            part = work(row, *_matrix(row, columns, k))
            held[row["slice"]] = held[row["slice"]] + part if row["slice"] in held else part
            if len(held) >= 64:  # bounded, however many slices a task meets
                yield _binary(held)
                held = {}
        yield _binary(held)
    return run


def _binary(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], ["slice", "part"])


def _moments(width: int, k: int):
    """Training rows, present cells, sums of every seed."""
    def work(row, x, y, train):
        there = ~np.isnan(x)
        return np.hstack([train.sum(1)[:, None], train @ there.T, train @ np.where(there, x, 0.0).T])
    return work


def _squares(width: int, k: int):
    """Sums and squares about the centre that the seeds share, in a second pass."""
    def work(row, x, y, train):
        off = np.nan_to_num(x - _floats(row["center"], width)[:, None])
        return np.stack([train @ off.T, train @ (off * off).T])
    return work


def _basis(row: dict, x: np.ndarray, width: int) -> np.ndarray:
    """What the seeds' standardized columns are sums of: centred columns, flags of missing cells, and one."""
    center, unit, miss = (_floats(row[c], width) for c in ("center", "unit", "miss"))
    gone, flagged = np.isnan(x), np.flatnonzero(miss)
    out = np.ones((width + len(flagged) + 1, x.shape[1]))
    out[:width] = np.where(gone, 0.0, (x - center[:, None]) * unit[:, None])
    out[width:-1] = gone[flagged]
    return out


def _change(row: dict, s: int, first: Sequence[int], width: int, k: int) -> np.ndarray:
    """Matrix that takes the basis to a seed's standardized columns and the intercept. `first`: a column's flag, by column."""
    fill, shift, scale = (_floats(row[c], k, width)[s] for c in ("fill", "shift", "scale"))
    center, unit, miss = (_floats(row[c], width) for c in ("center", "unit", "miss"))
    flagged, every = np.flatnonzero(miss).tolist(), np.arange(width)
    out = np.zeros((width + len(flagged) + 1, width + 1))
    out[every, every] = np.divide(scale, unit, out=np.zeros(width), where=unit > 0)
    out[-1, :width] = scale * (center - shift)
    for j in range(width):
        if miss[first[j]]:
            out[width + flagged.index(first[j]), j] = scale[j] * (fill[j] - center[j])
    out[-1, -1] = 1.0
    return out


def _first(columns) -> list[int]:
    """By column: the first column of its feature, as a text is missing in all of its levels."""
    names = [c for c, _ in columns]
    return [names.index(c) for c in names]


def _standard(x: np.ndarray, row: dict, s: int, width: int, k: int) -> np.ndarray:
    fill, shift, scale = (_floats(row[c], k, width)[s][:, None] for c in ("fill", "shift", "scale"))
    z = (np.where(np.isnan(x), fill, x) - shift) * scale
    return np.vstack([z, np.ones((1, x.shape[1]))])


def _gram(columns, k: int):
    """Gradient, Gram matrix and number of the training rows of every seed at the present weights, in the shared basis."""
    width, first = len(columns), _first(columns)

    def work(row, x, y, train):
        w, a = _floats(row["w"], k, width + 1), _basis(row, x, width)
        c = len(a)
        u = np.stack([_change(row, s, first, width, k) @ w[s] for s in range(k)])
        p = 1 / (1 + np.exp(-np.clip(u @ a, -35, 35)))
        out = np.zeros((k, c, c + 2))
        out[:, :, 0] = ((p - y) * train) @ a.T
        p *= (1 - p) * train
        for s in range(k):
            out[s, :, 1:-1] = (a * p[s]) @ a.T
        out[:, 0, -1] = train.sum(1)
        return out
    return work


def _total(table: pa.Table, *dims: int) -> np.ndarray:
    return sum(_floats(p, *dims) for p in table.column("part").to_pylist())


def _row(slice_: str, done: bool, rounds: int, **arrays: np.ndarray) -> pa.Table:
    cells = {"slice": pa.array([slice_]), "done": pa.array([done]), "rounds": pa.array([rounds], pa.int32())}
    return pa.table({**cells, **{c: pa.array([v.astype("<f8").tobytes()], pa.binary()) for c, v in arrays.items()}})


def _start(columns, k: int):
    """Fill values of a slice's seeds: means of numbers, the most frequent level of texts."""
    width, number = len(columns), _numbers(columns)

    def run(table: pa.Table) -> pa.Table:
        t = _total(table, k, 1 + 2 * width)
        n, there, total = t[:, 0], t[:, 1:1 + width], t[:, 1 + width:]
        fill = np.divide(total, there, out=np.zeros_like(total), where=there > 0)
        for name in {c for c, level in columns if level is not None}:
            at = [i for i, (c, level) in enumerate(columns) if c == name and level is not None]  # in the order of levels
            fill[:, at] = np.eye(len(at))[total[:, at].argmax(1)]
        center = np.where(number, np.divide(total.sum(0), there.sum(0), out=np.zeros(width), where=there.sum(0) > 0), 0.0)
        zero = np.zeros((k, width))
        return _row(table.column("slice")[0].as_py(), False, 0, n=n, fill=fill, shift=zero, scale=zero, w=np.zeros((k, width + 1)),
                    center=center, unit=np.ones(width), miss=(there < n[:, None]).any(0) & (np.array(_first(columns), int) == np.arange(width)))
    return run


def _numbers(columns) -> np.ndarray:
    return np.array([level is None for _, level in columns], bool)


def _scales(columns, k: int):
    width, number = len(columns), _numbers(columns)

    def run(table: pa.Table) -> pa.Table:
        old = table.slice(0, 1).to_pylist()[0]
        n, fill, center = _floats(old["n"], k), _floats(old["fill"], k, width), _floats(old["center"], width)
        sums, squares = _total(table, 2, k, width)
        # about the seed's own mean, which is near the centre; what rounding alone may leave of a constant is none
        own = np.where(number, fill - center, 0.0)
        about = squares - own * sums  # the sums are the present cells times `own`
        dev = np.sqrt(np.maximum(0.0, about) / np.maximum(1, n - 1)[:, None])
        dev = np.where(dev > 1e-13 * np.abs(fill), dev, 0.0)
        scale = np.where(number, np.divide(1, dev, out=np.zeros_like(dev), where=dev > 0), 1.0)
        return _row(old["slice"], False, 0, n=n, fill=fill, shift=np.where(number, fill, 0.0), scale=scale, w=np.zeros((k, width + 1)),
                    center=center, unit=scale.max(0), miss=_floats(old["miss"], width))
    return run


def _newton(columns, k: int, tolerance: float, longest: float = 5.0):
    width, first = len(columns), _first(columns)

    def run(table: pa.Table) -> pa.Table:
        old = table.slice(0, 1).to_pylist()[0]
        n, w = _floats(old["n"], k), _floats(old["w"], k, width + 1).copy()
        c = width + np.count_nonzero(_floats(old["miss"], width)) + 1
        t = _total(table, k, c, c + 2)
        ridge = np.append(np.ones(width), 0.0)
        most = 0.0
        for s in range(k):
            step = np.zeros(width + 1)
            if t[s, 0, -1]:
                to = _change(old, s, first, width, k)
                part = ridge * t[s, 0, -1] / n[s]  # of all rows: 1
                step = np.linalg.solve(to.T @ t[s, :, 1:-1] @ to + np.diag(part + 1e-12), to.T @ t[s, :, 0] + part * w[s])
            size = np.abs(step).max(initial=0)
            w[s] -= step * min(1.0, longest / size) if size else 0.0
            most = max(most, size)
        return _row(old["slice"], most < tolerance, old["rounds"] + 1, n=n, w=w, **{c: _floats(old[c], k, width) for c in ("fill", "shift", "scale")},
                    **{c: _floats(old[c], width) for c in ("center", "unit", "miss")})
    return run


def _reduced(packed: DataFrame, state: DataFrame | None, work, finish, columns, k: int) -> DataFrame:
    """Sum `work` over the blocks of each slice of `state`, then `finish` per slice; written, as the next step starts from it."""
    at = packed.select("slice", "rows", "x", "codes", "y", "test")
    at = at if state is None else at.join(state, "slice")
    parts = at.mapInArrow(_sums(work, columns, k), "slice string, part binary")
    if state is not None:
        parts = parts.join(state, "slice")
    return materialize(parts.groupBy("slice").applyInArrow(finish, STATE))


def _steps(packed: DataFrame, state: DataFrame, columns, k: int, tolerance: float, rounds: int) -> DataFrame:
    """`state` after Newton steps over the blocks until a slice's last step was below the tolerance."""
    done = None
    for _ in range(rounds):
        state = _reduced(packed, state, _gram(columns, k), _newton(columns, k, tolerance), columns, k)
        ready = state.where("done")
        done = ready if done is None else done.unionByName(ready)
        state = state.where("NOT done")
        if state.isEmpty():
            return done
    return done.unionByName(state)


def fit(packed: DataFrame, columns: Sequence[tuple[str, str | None]], k: int, tolerance: float = 1e-9, rounds: int = 50,
        many: int = MANY_BLOCKS) -> DataFrame:
    """One row per slice with the weights of all seeds, intercept last, in standardized units.

    With `many` blocks a slice on average, the first steps see every sixteenth block and an
    equal share of the penalty: they only tell where the steps over all rows begin, which go
    on to the tolerance as from anywhere else, towards the one minimum there is.
    """
    width = len(columns)
    state = _reduced(packed, None, _moments(width, k), _start(columns, k), columns, k)
    state = _reduced(packed, state, _squares(width, k), _scales(columns, k), columns, k)
    if packed.count() >= many * max(1, state.count()):
        few = materialize(packed.where(F.pmod("part", F.lit(16)) == 0).select("slice", "rows", "x", "codes", "y", "test"))
        begin = _steps(few, state, columns, k, 1e-2, rounds).select("slice", F.col("w").alias("__w"))
        state = materialize(state.join(begin, "slice", "left").withColumn("w", F.coalesce("__w", "w")).drop("__w"))
    return _steps(packed, state, columns, k, tolerance, rounds)


def predict(packed: DataFrame, state: DataFrame, seeds: Sequence[int], columns: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Predictions of every slice and seed on its test rows, with the columns of the model grid."""
    k, width, prot = len(seeds), len(columns), [c for c in packed.columns if c.startswith(PREFIX)]
    schema = "slice string, model_family string, seed int, key string, y_true int, y_pred int, y_score double" + "".join(f", `{p}` string" for p in prot)

    def run(batches):
        for row in _batches_of(batches):
            x, y, train = _matrix(row, columns, k)
            w = _floats(row["w"], k, width + 1)
            for s, seed in enumerate(seeds):
                at = np.flatnonzero(train[s] == 0)
                p = 1 / (1 + np.exp(-np.clip(w[s] @ _standard(x[:, at], row, s, width, k), -700, 700)))
                rows = pa.array(at)
                cells = [pa.repeat(pa.scalar(row["slice"], pa.string()), len(at)), pa.repeat(pa.scalar("logreg"), len(at)), pa.array(np.full(len(at), seed, np.int32)),
                         row["keys"].take(rows), pa.array(y[at].astype(np.int32)), pa.array((p >= 0.5).astype(np.int32)), pa.array(p),
                         *[row[c].take(rows) for c in prot]]
                yield pa.RecordBatch.from_arrays(cells, ["slice", "model_family", "seed", "key", "y_true", "y_pred", "y_score", *prot])
    cells = packed.select("slice", "rows", "x", "codes", "y", "test", "keys", *prot)
    return cells.join(state.select("slice", "fill", "shift", "scale", "w"), "slice").mapInArrow(run, schema)


def logreg_slices(slices: DataFrame, target: str, key: str, features: Sequence[str], protected: Sequence[str] = (),
                  seeds: Sequence[int] = (42, 43, 44, 45, 46), test_size: float = 0.2) -> tuple[DataFrame, DataFrame, list[tuple[str, str | None]]]:
    """(predictions, weights per slice, matrix columns). Slices under `MIN_ROWS` labelled rows are left out; `key` tells rows of a slice apart."""
    packed, columns = blocks(slices, target, key, features, seeds, test_size, protected)
    state = fit(packed, columns, len(seeds))
    return predict(packed, state, seeds, columns), state, columns


def weights(state: DataFrame, columns: Sequence[tuple[str, str | None]], seeds: Sequence[int]) -> DataFrame:
    """(slice, seed, rounds, w): weights as an array in the order of `columns`, then the intercept."""
    width, k = len(columns), len(seeds)

    def run(batches):
        for r in _batches_of(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["slice"]] * k), pa.array(list(seeds), pa.int32()), pa.array([r["rounds"]] * k, pa.int32()),
                 pa.array(_floats(r["w"], k, width + 1).tolist(), pa.list_(pa.float64()))], ["slice", "seed", "rounds", "w"])
    return state.mapInArrow(run, "slice string, seed int, rounds int, w array<double>")
