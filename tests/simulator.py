"""A plain single-threaded worklist, independent of the engine: the yardstick of the tests."""

from __future__ import annotations

from collections import deque


def explore(net: dict, limit: int = 5_000) -> list[tuple[tuple[int, ...], tuple[int, ...]]] | None:
    """(path, marking) in first-in first-out order; None beyond ``limit`` states. For nets whose subnets cover all arcs."""
    start = tuple(net["M0"])
    minus, plus = net["I_minus"], net["I_plus"]
    seen, out = {start}, [((), start)]
    todo = deque([((), start, (start,))])
    while todo:
        path, m, chain = todo.popleft()
        for t in range(len(minus[0])):
            if any(x != -1 and row[t] > x for x, row in zip(m, minus)):
                continue
            fired = [x if x == -1 else x - a[t] + b[t] for x, a, b in zip(m, minus, plus)]
            grown = set()
            for old in chain:
                pairs = [(i, old[i], fired[i]) for i in range(len(fired)) if old[i] != -1 and fired[i] != -1]
                if all(y >= x for _, x, y in pairs):
                    grown |= {i for i, x, y in pairs if y > x}
            new = tuple(-1 if i in grown else x for i, x in enumerate(fired))
            if new in seen:
                continue
            seen.add(new)
            out.append(((*path, t), new))
            if len(out) > limit:
                return None
            todo.append(((*path, t), new, (*chain, new)))
    return out
