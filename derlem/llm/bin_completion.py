"""Bin completion over a histogram of item lengths.

Lengths are at most the capacity, so a histogram of them is small whatever the number of items, and a packing is a list of
(filling, times). Bins are completed around the longest item left: fillings of its rest are enumerated, those that another
dominates are dropped, and the best is used as often as the counts allow. Branch and bound keeps the best packing seen so far,
at first that of best-fit decreasing, and cuts a branch as soon as its bins and the waste bound of what is left can't beat it."""

from __future__ import annotations

from bisect import bisect_left, insort

Packing = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, and by items that can't share a bin (Martello and Toth's second bound)."""
    best = -(-sum(length * n for length, n in counts.items()) // capacity)
    for k in sorted({length for length in counts if 2 * length <= capacity} | {0}):
        alone = sum(n for length, n in counts.items() if length > capacity - k)
        large = {length: n for length, n in counts.items() if capacity - k >= length and 2 * length > capacity}
        small = sum(length * n for length, n in counts.items() if k <= length and 2 * length <= capacity)
        bins = sum(large.values())
        room = sum((capacity - length) * n for length, n in large.items())
        best = max(best, alone + bins + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Packing:
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rests: list[int] = []

    def put(filling: tuple[int, ...], times: int) -> None:
        rest = capacity - sum(filling)
        if rest not in open_bins:
            open_bins[rest] = []
            insort(rests, rest)
        open_bins[rest].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rests, length)
            if at == len(rests):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                    left %= each
                if left:
                    put((length,) * left, 1)
                    left = 0
                break
            rest = rests[at]
            filling, times = open_bins[rest].pop()
            if not open_bins[rest]:
                del open_bins[rest]
                rests.pop(at)
            each = min(left, rest // length) if times == 1 else rest // length
            if times * each > left:
                each, used = (each, left // each) if left >= each else (left, 1)
            else:
                used = times
            put(filling + (length,) * each, used)
            if times > used:
                put(filling, times - used)
            left -= used * each
    return [x for rest in open_bins for x in open_bins[rest]]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's items fit into bins of the sizes of a's."""
    if len(a) > 6 or len(b) > 8:
        return False

    def fit(rooms: list[int], k: int) -> bool:
        if k == len(b):
            return True
        for i, room in enumerate(rooms):
            if room >= b[k] and room not in rooms[:i]:
                rooms[i] -= b[k]
                if fit(rooms, k + 1):
                    return True
                rooms[i] += b[k]
        return False

    return fit(list(a), 0)


def fillings(lengths: list[int], counts: dict[int, int], rest: int, most: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a rest, those that waste least first; lengths ascend. A search of a bounded number of steps."""
    found: set[tuple[int, ...]] = set()
    left_steps = steps

    def search(rest: int, high: int, chosen: tuple[int, ...]) -> None:
        nonlocal left_steps
        left_steps -= 1
        at = min(high, bisect_left(lengths, rest + 1)) - 1
        while at >= 0 and not counts[lengths[at]]:
            at -= 1
        if at < 0 or left_steps <= 0:
            found.add(chosen)
            return
        while at >= 0 and left_steps > 0:
            length = lengths[at]
            if counts[length]:
                for times in range(min(counts[length], rest // length), 0, -1):
                    before = len(found)
                    search(rest - times * length, at, chosen + (length,) * times)
                    if left_steps <= 0 or sum(1 for f in found if sum(f) == target) >= most:
                        return
                    if len(found) == before:
                        break
            at -= 1

    target = rest
    search(rest, len(lengths), ())
    best = sorted(found, key=lambda f: (-sum(f), len(f), [-x for x in f]))[: 4 * most]
    kept: list[tuple[int, ...]] = []
    for f in best:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept or [()]


def pack(counts: dict[int, int], capacity: int, nodes: int = 6_000, branch: int = 3, steps: int = 300) -> Packing:
    """A packing of few bins; stops at the lower bound, or after a number of search nodes with the best found."""
    counts = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be 1 to the capacity")
    incumbent = best_fit_decreasing(counts, capacity)
    best, bound = sum(t for _, t in incumbent), lower_bound(counts, capacity)
    lengths, spent = sorted(counts), 0
    # A stack of (what is left, bins so far, the fillings so far as a linked list, choices not tried yet).
    left, total = dict(counts), sum(length * n for length, n in counts.items())

    def options() -> list[tuple[int, ...]]:
        longest = next(x for x in reversed(lengths) if left[x])
        left[longest] -= 1
        out = [(longest, *f) for f in fillings(lengths, left, capacity - longest, branch, steps)]
        left[longest] += 1
        return out

    bins, path = 0, []  # path: (filling, times, other options)
    todo = options() if total else []
    while best > bound and spent < nodes:
        spent += 1
        if total and todo and bins + -(-total // capacity) < best:
            filling, *others = todo
            need = {x: filling.count(x) for x in filling}
            times = min(left[x] // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            total -= times * sum(filling)
            bins += times
            path.append((filling, times, others))
            todo = options() if total else []
            if total:
                continue
            if bins < best:
                best, incumbent = bins, [(f, t) for f, t, _ in path]
        while path:  # back to the last place with another choice
            filling, times, todo = path.pop()
            for x in filling:
                left[x] += times
            total += times * sum(filling)
            bins -= times
            if todo:
                break
        else:
            break
    return incumbent
