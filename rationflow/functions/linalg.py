"""Closed-form small-matrix algebra over arrays.

The least-cost ration works with bases of at most 4 ingredients, so every
linear system it meets is at most 4x4: cofactors are expanded, elementwise over
many matrices at once.  A matrix is a list of rows whose entries are arrays.
"""

from __future__ import annotations


def det(m: list[list]):
    """Laplace expansion along the first row."""
    k = len(m)
    if k == 1:
        return m[0][0]
    if k == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    total = 0.0
    for j in range(k):
        term = m[0][j] * det([row[:j] + row[j + 1:] for row in m[1:]])
        total = total + term if j % 2 == 0 else total - term
    return total


def cofactors(m: list[list]) -> list[list]:
    """Signed cofactors, C[r][c]."""
    k = len(m)
    if k == 1:
        return [[m[0][0] * 0 + 1.0]]
    minor = lambda r, c: det([row[:c] + row[c + 1:] for i, row in enumerate(m) if i != r])
    return [[minor(r, c) if (r + c) % 2 == 0 else -minor(r, c) for c in range(k)] for r in range(k)]
