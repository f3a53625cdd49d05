"""A flow solver for small graphs, to compare with."""

from collections import deque
from collections.abc import Mapping, Sequence


class Flow:
    """Maximum flow by levels and blocking paths (Dinic), with integer capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[s], queue = 0, deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return total
            at = [0] * len(self.out)
            while path := self._path(s, t, level, at):
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push

    def _path(self, s: int, t: int, level: list[int], at: list[int]) -> list[int]:
        path: list[int] = []
        a = s
        while a != t:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if self.room[e] and level[self.to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if not path:
                    return []
                a = self.to[path.pop() ^ 1]
                at[a] += 1
                continue
            path.append(self.out[a][at[a]])
            a = self.to[path[-1]]
        return path


def match_cells(quotas: Mapping, edges: Sequence[tuple]) -> tuple[int, list[tuple]]:
    """(rows matched, chosen (cell, cluster) edges): every cluster at most once, every cell at most its quota."""
    cells, clusters = sorted(quotas, key=str), sorted({c for _, c in edges}, key=str)
    number = {("cell", c): i + 1 for i, c in enumerate(cells)} | {("cluster", c): len(cells) + 1 + i for i, c in enumerate(clusters)}
    sink = len(number) + 1
    flow = Flow(sink + 1)
    for c in cells:
        flow.edge(0, number["cell", c], quotas[c])
    ids = [(flow.edge(number["cell", a], number["cluster", b], 1), a, b) for a, b in edges if a in quotas]
    for c in clusters:
        flow.edge(number["cluster", c], sink, 1)
    return flow.run(0, sink), [(a, b) for e, a, b in ids if not flow.room[e]]
