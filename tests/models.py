"""Plain serial models that the operators are compared with."""

K = 6


def within(a: str, b: str, d: int) -> int:
    """Edit distance of a and b if at most d, else -1."""
    if abs(len(a) - len(b)) > d:
        return -1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return last[-1] if last[-1] <= d else -1


def infix_within(umi: str, founder: str, d: int, side: int = 3) -> int:
    """Distance of the padded barcode to the best infix of the padded founder: an overhang of the founder costs
    at most `side`."""
    pad = "N" * side
    a, b = pad + umi + pad, pad + founder + pad
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return min(last) if min(last) <= d else -1


def _grams(umi: str) -> set[str]:
    up = umi.upper()
    return {g for i in range(len(up) - K + 1) if set(g := up[i:i + K]) <= set("ACGT")}


def serial(rows: list[tuple[str, int, int]], d: int, min_reads: int = 1, greedy: bool = False, pool: int = 48_000, head: int = 1_000, overhang: bool = False) -> list[tuple[int, int, int, bool]]:
    """One group in order, by an inverted index: (input_pos, founder_pos, dist, is_founder) for (umi, n, input_pos).

    Greedy mode works in batches of `pool` rows: the first `head` of a batch are taken in order, the others accept
    any founder known before the batch within d, nearest first, without waiting for founders of their own batch.
    """
    distance = infix_within if overhang else within
    index: dict[str, list[int]] = {}
    founders: list[tuple[str, int]] = []
    out: list[tuple[int, int, int, bool]] = []

    def nearest(umi: str, most: int) -> tuple[int, int] | None:
        hit = sorted({k for g in _grams(umi) for k in index.get(g, ()) if k < most})
        near = [(x, k) for k in hit if (x := distance(umi, founders[k][0], d)) >= 0]
        return min(near) if near else None

    def found(umi: str, pos: int) -> None:
        for g in _grams(umi):
            index.setdefault(g, []).append(len(founders))
        founders.append((umi, pos))
        out.append((pos, pos, 0, True))

    high = sorted((r for r in rows if r[1] >= min_reads), key=lambda r: r[2])
    for start in range(0, len(high), pool if greedy else max(1, len(high))):
        batch = high[start:start + pool] if greedy else high
        waiting = list(batch[:head] if greedy else batch)
        known = None
        for umi, _, pos in waiting:
            best = nearest(umi, len(founders))
            out.append((pos, founders[best[1]][1], best[0], False)) if best else found(umi, pos)
        if greedy:
            known, rest = len(founders), []
            for umi, n, pos in batch[head:]:
                best = nearest(umi, known)
                out.append((pos, founders[best[1]][1], best[0], False)) if best else rest.append((umi, n, pos))
            for umi, _, pos in rest:
                best = nearest(umi, len(founders))
                out.append((pos, founders[best[1]][1], best[0], False)) if best else found(umi, pos)
    for umi, n, pos in rows:
        if n < min_reads:
            best = nearest(umi, len(founders))
            out.append((pos, founders[best[1]][1], best[0], False) if best else (pos, pos, 0, False))
    return out


def local(a: str, b: str) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of a in b, places in b: the first to end, then the shortest."""
    last, best = [(0, j) for j in range(len(b) + 1)], (0, 0, 0)
    for x in a:
        now = [(0, 0)]
        for j, y in enumerate(b, 1):
            s = max((last[j - 1][0] + (1 if x == y else -1), last[j - 1][1]), (last[j][0] - 1, last[j][1]), (now[-1][0] - 1, now[-1][1]), (0, j))
            now.append(s)
            best = max(best, (s[0], -j, s[1]))
        last = now
    return best[0], best[2], -best[1]


def threshold_clusters(umis: list[str], threshold: int, stop_below: float = 0.0, window: int = 20) -> list[tuple[int, int, int]]:
    """(place, cluster, size) of one group in order."""
    left, out, sizes = list(enumerate(umis)), [], []
    while left:
        if stop_below and len(sizes) >= window and sum(sizes[-window:]) / window <= stop_below:
            return out + [(i, len(sizes) + k, 1) for k, (i, _) in enumerate(left)]
        taken = [left[0]] + [x for x in left[1:] if local(left[0][1], x[1])[0] > threshold]
        out += [(i, len(sizes), len(taken)) for i, _ in taken]
        sizes.append(len(taken))
        gone = {i for i, _ in taken}
        left = [x for x in left if x[0] not in gone]
    return out


def threshold_scan(groups: list[list[str]], thresholds: list[int], samples: int = 25, most: int = 200) -> dict[int, tuple[float, float]]:
    """(mean similarity, median size) of each threshold."""
    import statistics

    out = {}
    for t in thresholds:
        similar, sizes = [], []
        for umis in groups:
            members = {}
            for i, c, _ in sorted(threshold_clusters(umis, t)):
                members.setdefault(c, []).append(umis[i])
            for c in range(min(samples, len(members))):
                few = members[c][:most]
                scores = [local(a, b)[0] for i, a in enumerate(few) for b in few[i + 1:]]
                similar.append(sum(scores) / len(scores) if scores else 0.0)
                sizes.append(len(members[c]))
        out[t] = (sum(similar) / len(similar), statistics.median(sizes))
    return out
