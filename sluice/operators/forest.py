"""Isolation forest: bounded samples per tree, trees broadcast, rows scored where they lie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_ranked

TREES, SAMPLE = 100, 256
TREE = "tree int, node int, left int, right int, size int, depth int, normal array<double>, offset double"


def tree_samples(rows: DataFrame, key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``sample`` hashed rows per tree.

    A first hash threshold keeps about four times the rows needed before anything is
    repeated per tree, then the exact number is taken with a group limit below the
    shuffle. The draw is the operator's own sampling, not a shortcut.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    u = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 40))
    limit = F.least(F.lit(1.0), F.lit(4.0 * sample) / n) * float(1 << 40)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(t) < F.col("__limit"))
    spread = rows.withColumn("__limit", limit).withColumn("tree", F.explode(chosen)).drop("__limit")
    return top_ranked(spread, ["tree"], [u(F.col("tree")), F.col(key)], sample).drop("rank")


def fit_forest(rows: DataFrame, key: str, names: Sequence[str], trees: int = TREES, sample: int = SAMPLE, extension: int = 1, seed: int = 7) -> DataFrame:
    """Nodes of every tree. Each group is one tree's bounded sample.

    A split is a hyperplane through a random point of the node's box with
    ``extension`` + 1 non-zero directions (0 gives axis-parallel cuts).
    """
    import numpy as np
    import pandas as pd

    names = list(names)
    dims = len(names)
    columns = [c.split()[0] for c in TREE.split(", ")]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, tree = pdf[names].to_numpy(float), int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1000 + tree)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        out, todo = [], [(0, np.arange(len(x)), 0)]
        count = 1
        while todo:
            node, idx, depth = todo.pop()
            part = x[idx]
            low, high = part.min(axis=0), part.max(axis=0)
            if depth >= limit or len(idx) <= 1 or not (high > low).any():
                out.append((tree, node, -1, -1, len(idx), depth, None, None))
                continue
            normal = rng.normal(size=dims)
            drop = rng.permutation(dims)[: dims - min(extension + 1, dims)]
            normal[drop] = 0.0
            cut = float(rng.uniform(low, high) @ normal)
            side = part @ normal <= cut
            left, right = count, count + 1
            count += 2
            out.append((tree, node, left, right, len(idx), depth, normal.tolist(), cut))
            todo += [(left, idx[side], depth + 1), (right, idx[~side], depth + 1)]
            if side.all() or not side.any():
                # an empty side ends at once with its depth
                empty, full = (right, left) if side.all() else (left, right)
                todo = [t for t in todo if t[0] != empty]
                out.append((tree, empty, -1, -1, 0, depth + 1, None, None))
        return pd.DataFrame(out, columns=columns)

    return tree_samples(rows, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, TREE)


def _average_path(n):
    import numpy as np

    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def score_forest(rows: DataFrame, keep: Sequence[str], names: Sequence[str], forest: DataFrame, sample: int = SAMPLE, out: str = "raw") -> DataFrame:
    """Anomaly score 2^(-mean path / c(sample)) of every row.

    The forest has at most trees x (2 x sample) nodes by construction, so it is
    collected once and sent to the executors; rows are scored in Arrow batches without
    a shuffle.
    """
    import numpy as np
    import pandas as pd

    names, keep = list(names), list(keep)
    trees: dict[int, list] = {}
    for r in forest.collect():
        trees.setdefault(r["tree"], []).append(r)
    packed = []
    for _, nodes in sorted(trees.items()):
        nodes.sort(key=lambda r: r["node"])
        size = max(r["node"] for r in nodes) + 1
        left, right = np.full(size, -1), np.full(size, -1)
        normal, offset, leaf = np.zeros((size, len(names))), np.zeros(size), np.zeros(size)
        for r in nodes:
            i = r["node"]
            left[i], right[i] = r["left"], r["right"]
            leaf[i] = r["depth"] + _average_path(r["size"])
            if r["normal"] is not None:
                normal[i], offset[i] = r["normal"], r["offset"]
        packed.append((left, right, normal, offset, leaf))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(packed)
    scale = float(_average_path(sample))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            total = np.zeros(len(x))
            for left, right, normal, offset, leaf in shared.value:
                at = np.zeros(len(x), int)
                for _ in range(64):
                    inner = left[at] >= 0
                    if not inner.any():
                        break
                    goes = np.einsum("ij,ij->i", x, normal[at]) <= offset[at]
                    at = np.where(inner, np.where(goes, left[at], right[at]), at)
                total += leaf[at]
            yield pdf[keep].assign(**{out: np.power(2.0, -(total / max(len(shared.value), 1)) / scale)})

    fields = rows.select(*keep).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return rows.select(*dict.fromkeys([*keep, *names])).mapInPandas(score, f"{fields}, {out} double")


def calibrated(scored: DataFrame, threshold, steepness: float = 6.0) -> DataFrame:
    """Logistic squeeze around the threshold (0.5 at it)."""
    return scored.withColumn("score", 1 / (1 + F.exp(-steepness * (F.col("raw") - threshold))))


def ablation_importance(rows: DataFrame, key: str, names: Sequence[str], forest: DataFrame, k: int = 3) -> DataFrame:
    """Change of the score when one feature is zeroed, the k largest by size.

    Every row is repeated once per feature (a fixed number) and scored in the same
    pass as the base score.
    """
    names = list(names)
    which = F.explode(F.array(*[F.lit(i) for i in range(-1, len(names))])).alias("zeroed")
    wide = rows.select(key, *names, which)
    wide = wide.select(key, "zeroed", *[F.when(F.col("zeroed") == i, 0.0).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)])
    scored = score_forest(wide, [key, "zeroed"], names, forest)
    base = scored.where("zeroed = -1").select(key, F.col("raw").alias("base"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("zeroed") + 1)
    delta = scored.where("zeroed >= 0").join(base, key).select(key, label.alias("feature"), (F.col("raw") - F.col("base")).alias("contribution"))
    return top_ranked(delta, [key], [F.desc(F.abs("contribution")), F.col("feature")], k)
