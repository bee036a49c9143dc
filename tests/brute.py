"""Brute force over all assignments, for comparison with the matcher."""

from __future__ import annotations

from itertools import permutations


def brute_force(vertices: dict[int, int], edges: set[tuple[int, int]], pattern) -> list[tuple]:
    order = [v for v, _ in pattern.vertices]
    found = []
    for choice in permutations(vertices, len(order)):
        bound = dict(zip(order, choice))
        if all(vertices[bound[v]] == tag for v, tag in pattern.vertices) and all(
            (bound[a], bound[b]) in edges for a, b in pattern.edges
        ):
            found.append(choice)
    return sorted(found)
