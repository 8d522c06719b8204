"""Plain-Python statement of the detector, for comparison on small series."""

import math


def components(points, eps):
    n = len(points)
    seen, groups = [False] * n, []
    for i in range(n):
        if seen[i]:
            continue
        seen[i], group, todo = True, [], [i]
        while todo:
            a = todo.pop()
            group.append(a)
            for b in range(n):
                if not seen[b]:
                    dx, dy = points[a][0] - points[b][0], points[a][1] - points[b][1]
                    if math.sqrt(dx * dx + dy * dy) <= eps:
                        seen[b] = True
                        todo.append(b)
        groups.append(sorted(group))
    clusters = sorted((g for g in groups if len(g) > 1), key=lambda g: g[0])
    noise = sorted(g[0] for g in groups if len(g) == 1)
    return clusters, noise


def candidates(points, eps, temp_eps=0.8):
    clusters, noise = components(points, eps)
    dense = [c for c in clusters if len(c) / (c[-1] - c[0] + 1.0) >= 1.0 - temp_eps]
    found = []
    for a in range(len(dense)):
        for b in range(a + 1, len(dense)):
            if dense[a][-1] < dense[b][0]:
                between = [i for i in noise if dense[a][-1] < i < dense[b][0]]
                if between:
                    found.append((dense[a], dense[b], between))
    return found


def loss(c1, c2, between):
    low, high = between[0] - 1, between[-1] + 1
    return (
        sum(1 for i in c2 if i <= low)
        + sum(1 for i in c1 if i >= high)
        + sum(1 for i in c1 + c2 if low < i < high)
    )


def best(points, eps, temp_eps=0.8, thresh=40):
    found = candidates(points, eps, temp_eps)
    if not found:
        return None
    losses = [loss(*c) for c in found]
    if min(losses) > thresh:
        return None
    return found[losses.index(min(losses))][2]


def predict(points, eps, temp_eps=0.8):
    kept = best(points, eps, temp_eps)
    if kept is None:
        return None
    for cut in range(1, len(points)):
        shorter = best(points[cut:], eps, temp_eps)
        if shorter is None:
            return kept[0] + cut, kept[-1] + cut
        kept = shorter
    return kept[0], kept[-1]


def detect(points, eps, temp_eps=0.8, w2=100):
    """Rows (s, d, event_s, event_start, event_end), one per feature, and the restarts."""
    rows, restarts, start = [], [], 0
    for t in range(len(points)):
        event = predict(points[start : t + 1], eps, temp_eps)
        if event is None:
            rows.append((t, False, -1, None, None))
            if t + 1 - start > w2:
                start = t + 1
                restarts.append((t, start, False))
        else:
            a, b = event
            rows.append((t, True, start + (a + b) // 2 + 1, start + a, start + b))
            start += b
            restarts.append((t, start, True))
    return rows, restarts
