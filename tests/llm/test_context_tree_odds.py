"""Chances stay finite and right where a bit was nearly always the same."""

import math

import numpy as np


def test_rare_byte_after_a_frequent_context():
    from quarry.llm.context_tree import log10_chance, subtree, top_levels

    # One byte alone ever followed this context, 100 million times; every other byte is scored by the root-to-leaf mixture.
    n, depth = 10**8, 2
    levels, given = subtree(np.array([int.from_bytes(b"the", "big")], np.uint64), np.array([n], np.int64), depth)
    none = (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
    levels = [*top_levels(given[0][1:], none)[:2], *levels]
    rare = log10_chance(levels, np.array([int.from_bytes(b"th" + bytes([ord("e") ^ 1]), "big")], np.uint64))[0]
    # All levels have the same counts, so the mixture is the estimate itself: seven bits as ever, the last never seen.
    seen = math.log10((n + 0.5) / (n + 1))
    assert math.isclose(rare, 7 * seen + math.log10(0.5 / (n + 1)), rel_tol=1e-6)
