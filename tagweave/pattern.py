"""The small query graph: tagged vertices, directed edges, and its stars."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field


def column(vertex: int) -> str:
    """Name of the match column that holds the data vertex for a query vertex."""
    return f"v{vertex}"


@dataclass(frozen=True)
class Star:
    """A query vertex with out-edges, and the query vertices they lead to."""

    star_id: int
    root: int
    root_tag: int
    children: tuple[tuple[int, int], ...]  # (query vertex, tag), in vertex order

    @property
    def child_ids(self) -> tuple[int, ...]:
        return tuple(child for child, _ in self.children)

    @property
    def out_degree(self) -> int:
        return len(self.children)

    @property
    def required(self) -> dict[int, int]:
        """Child tag -> number of children of the star that carry it."""
        return dict(sorted(Counter(tag for _, tag in self.children).items()))


@dataclass(frozen=True)
class Pattern:
    """A query graph. Vertex order is the column order of the matches."""

    vertices: tuple[tuple[int, int], ...]
    edges: tuple[tuple[int, int], ...] = ()
    tag_of: dict[int, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        vertices = tuple((int(v), int(tag)) for v, tag in self.vertices)
        edges = tuple(dict.fromkeys((int(a), int(b)) for a, b in self.edges))
        if not vertices:
            raise ValueError("a pattern needs at least one vertex")
        repeated = [v for v, n in Counter(v for v, _ in vertices).items() if n > 1]
        if repeated:
            raise ValueError(f"pattern vertices listed more than once: {repeated}")
        tag_of = dict(vertices)
        wide = [v for v, tag in vertices if not (-(2**63) <= v < 2**63 and -(2**31) <= tag < 2**31)]
        if wide:
            raise ValueError(f"pattern vertices beyond 64-bit ids or 32-bit tags: {wide}")
        undeclared = sorted({v for edge in edges for v in edge} - tag_of.keys())
        if undeclared:
            raise ValueError(f"pattern edges name undeclared vertices: {undeclared}")
        object.__setattr__(self, "vertices", vertices)
        object.__setattr__(self, "edges", edges)
        object.__setattr__(self, "tag_of", tag_of)

    @classmethod
    def parse(cls, vertices: str, edges: str = "") -> Pattern:
        """Short form: ``Pattern.parse("1:21 2:111", "1>2")``."""
        return cls(
            tuple(tuple(map(int, item.split(":"))) for item in vertices.split()),
            tuple(tuple(map(int, item.split(">"))) for item in edges.split()),
        )

    @property
    def columns(self) -> list[str]:
        return [column(v) for v, _ in self.vertices]

    @property
    def stars(self) -> list[Star]:
        """One star per vertex with out-edges, roots and children in vertex order."""
        targets: dict[int, set[int]] = {}
        for a, b in self.edges:
            targets.setdefault(a, set()).add(b)
        with_children = [(v, tag) for v, tag in self.vertices if v in targets]
        return [
            Star(i, root, tag, tuple((v, t) for v, t in self.vertices if v in targets[root]))
            for i, (root, tag) in enumerate(with_children)
        ]

    def tag_pair(self, edge: tuple[int, int]) -> tuple[int, int]:
        return self.tag_of[edge[0]], self.tag_of[edge[1]]

    def same_tag(self, vertex: int, others: Iterable[int]) -> list[int]:
        """Those of ``others`` that could be given the same data vertex as ``vertex``."""
        return [o for o in others if o != vertex and self.tag_of[o] == self.tag_of[vertex]]

    def components(self) -> list[Pattern]:
        """Connected parts, direction ignored, ordered by their first vertex."""
        group = {v: {v} for v, _ in self.vertices}
        for a, b in self.edges:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for v in group[b]:
                    group[v] = group[a]
        parts = list({id(members): members for members in group.values()}.values())
        return [self.restricted_to(members) for members in parts]

    def restricted_to(self, members: Iterable[int]) -> Pattern:
        keep = set(members)
        return Pattern(
            tuple((v, tag) for v, tag in self.vertices if v in keep),
            tuple((a, b) for a, b in self.edges if a in keep and b in keep),
        )
