"""Dense kernels: all pairs within one video, as blocked matrix products.

A pair join would write one row per pair; here the tokens of a video meet in one
task as a matrix, pairs exist only as blocks of ``BLOCK`` rows, and the output has one
row per token.  Memory per task: the matrix of one video and one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = 1024


def matrix(column) -> np.ndarray:
    """A list column as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False) if len(column) else np.zeros((0, 0))


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {n: matrix(table[n]) if pa.types.is_list(table.schema.field(n).type) else table[n].to_numpy() for n in table.schema.names}


def _table(out: dict, schema: pa.Schema) -> pa.Table:
    arrays = []
    for field in schema:
        x = out[field.name]
        if pa.types.is_list(field.type) and isinstance(x, np.ndarray):
            x = list(x)
        arrays.append(pa.array(x, field.type))
    return pa.table(arrays, schema=schema)


def per_key(df: DataFrame, keys: list[str], order: list[str], f: Callable[[dict], dict], schema: str) -> DataFrame:
    """``f`` on the columns of each group, sorted by ``order``; single values are repeated."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        cols = _columns(table)
        out = f(cols)
        n = max((len(v) for v in out.values() if isinstance(v, (np.ndarray, list))), default=1)
        for k in keys:
            out.setdefault(k, cols[k][0])
        return _table({k: v if isinstance(v, (np.ndarray, list)) else [v] * n for k, v in out.items()}, arrow)

    return df.groupBy(*keys).applyInArrow(go, schema)


def per_pair(left: DataFrame, right: DataFrame, keys: list[str], order: tuple[list[str], list[str]], f: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """``f`` on the groups of two tables with equal keys; keys that the left one lacks give nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return arrow.empty_table()
        one, two = (t.sort_by([(c, "ascending") for c in o]) for t, o in ((a, order[0]), (b, order[1])))
        cols = _columns(one)
        out = f(cols, _columns(two))
        n = max((len(v) for v in out.values() if isinstance(v, (np.ndarray, list))), default=1)
        for k in keys:
            out.setdefault(k, cols[k][0])
        return _table({k: v if isinstance(v, (np.ndarray, list)) else [v] * n for k, v in out.items()}, arrow)

    right = right.toDF(*right.columns)  # columns of its own, also where both come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(go, schema)


def unit(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), eps)


def blocks(n: int, wide: int = BLOCK):
    """Runs of n rows, at most ``BLOCK`` of them and ``BLOCK`` squared entries of rows of ``wide``."""
    step = max(1, min(BLOCK, BLOCK * BLOCK // max(1, wide)))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def log_normaliser(target: np.ndarray, candidates: np.ndarray, temperature: float) -> np.ndarray:
    """log of the sum over all candidates of exp(target . candidate / temperature), streamed."""
    top, mass = np.full(len(target), -np.inf), np.zeros(len(target))
    for s in blocks(len(candidates)):
        x = target @ candidates[s].T / temperature
        new = np.maximum(top, x.max(1))
        mass = mass * np.exp(top - new) + np.exp(x - new[:, None]).sum(1)
        top = new
    return top + np.log(mass)


def softmax(target: np.ndarray, candidates: np.ndarray, temperature: float) -> np.ndarray:
    x = target @ candidates.T / temperature
    return np.exp(x - log_normaliser(target, candidates, temperature)[:, None])


def stable_top(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest, NaN last, ties to the lower index."""
    return np.argsort(-np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), kind="stable")[: max(0, k)]
