"""Interpolated Kneser-Ney smoothing over symbol n-grams that are packed into 64-bit keys, in numpy.

A key holds its symbols from the most to the least significant, `bits` each; symbol 0 pads the beginning of a text.
Lower orders count the distinct left extensions of each n-gram, so that the distinct n-grams of the
highest order, with their counts, are all that is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Order:
    """Sorted keys of one order with log probabilities, and sorted contexts with log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def estimate(keys: np.ndarray, counts: np.ndarray, n: int, bits: int, size: int) -> list[Order]:
    """Orders 1 to n of the model, from the distinct n-grams of order n; `size` is that of the alphabet."""
    tables: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(np.float64))]
    for k in range(n - 1, 0, -1):
        suffix, times = np.unique(tables[-1][0] & ((1 << bits * k) - 1), return_counts=True)
        tables.append((suffix, times.astype(np.float64)))
    tables.reverse()
    orders: list[Order] = []
    for k, (keys, counts) in enumerate(tables, 1):
        once, twice = float(np.count_nonzero(counts == 1)), float(np.count_nonzero(counts == 2))
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        context = keys >> bits
        first = np.ones(len(keys), bool)
        first[1:] = context[1:] != context[:-1]
        heads = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        total = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0)
        kinds = np.diff(np.append(heads, len(keys)))
        weight = discount * kinds / total
        lower = np.full(len(keys), 1.0 / size) if k == 1 else np.exp(orders[-1].logp[lookup(orders[-1].keys, keys & ((1 << bits * (k - 1)) - 1))])
        p = np.maximum(counts - discount, 0) / total[of] + weight[of] * lower
        orders.append(Order(keys, np.log(p), context[heads], np.log(weight)))
    return orders
