"""Exact Shapley values of boosted trees, along the paths of the trees.

A leaf counts for a set S of known features with its value, times one or nothing for each feature
of S on its path (does the row go that way), times the share of the training rows that went that
way for each feature outside S. With the features of a path and whether the row fits each of them
the leaf's values are fixed, so they are tabulated once: a leaf has 2 ** (features on its path)
patterns. Scoring a batch is a comparison and a look-up for each leaf. The model is the only thing
held, its size is that of its trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Leaf:
    """`value` (times the tree's weight) for rows with low < x <= high in each feature on the path."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted tree ensemble with continuous features."""
    out: list[Leaf] = []

    def walk(node, weight, path):
        if node.numDescendants() == 0:
            out.append(Leaf(weight * node.prediction(), list(path), *(np.array([b[k] for b in path.values()]) for k in range(3))))
            return
        at, cut, cover = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        low, high, share = path.get(at, (-np.inf, np.inf, 1.0))
        for child, bound in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, path | {at: (*bound, share * child.impurityStats().count() / cover)})

    for tree, weight in zip(model.trees, model.treeWeights):
        walk(tree._java_obj.rootNode() if hasattr(tree._java_obj, "rootNode") else tree._call_java("rootNode"), weight, {})
    return out


def tabulated(leaf: Leaf) -> np.ndarray:
    """The Shapley values of a leaf's features for every pattern of fitting features: (2 ** d, d)."""
    d = len(leaf.features)
    fits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    out = np.zeros((1 << d, d))
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for known in combinations(others, size):
                unknown = [j for j in others if j not in known]
                out[:, i] += weight * fits[:, list(known)].prod(axis=1) * leaf.share[unknown].prod() * (fits[:, i] - leaf.share[i])
    return out * leaf.value


def base_value(every: list[Leaf]) -> float:
    """What the model gives where nothing is known: the mean over its training rows."""
    return sum(leaf.value * leaf.share.prod() for leaf in every)


def shapley(x: np.ndarray, every: list[Leaf], tables: list[np.ndarray]) -> np.ndarray:
    """Shapley values of the rows of `x`; a row's values add up to its margin less the base value."""
    out = np.zeros(x.shape)
    for leaf, table in zip(every, tables):
        at = leaf.features
        if at:
            part = x[:, at]
            pattern = ((part > leaf.low) & (part <= leaf.high)) @ (1 << np.arange(len(at)))
            out[:, at] += table[pattern]
    return out


def explain(rows: DataFrame, features: list[str], model) -> DataFrame:
    """The rows with `shapley`, an array in the order of `features`."""
    every = leaves(model)
    tables = [tabulated(leaf) for leaf in every]
    columns, fields = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(batch.schema.names.index(f)).to_numpy(zero_copy_only=False), np.float64) for f in features], axis=1)
            values = shapley(x, every, tables)
            offsets = pa.array(np.arange(len(x) + 1) * len(features), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=[*columns, "shapley"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", shapley array<double>")
