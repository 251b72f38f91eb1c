"""Small sequential checks of the same rules, for random streams of a few hundred rows."""

from __future__ import annotations

import math
import random


def random_day(rng: random.Random, n: int, levels: int = 3):
    """Messages and the book after each; prices on a coarse grid so that everything happens."""
    rows, t, mid = [], 0.0, 100
    for i in range(n):
        t += rng.choice([0, 0.001, 0.3, 1, 4])
        if rng.random() < 0.12:
            mid += rng.choice([-1, 1])
        bid, ask = mid - 1, mid + rng.choice([0, 0, 1])
        typ = rng.choice([1, 1, 1, 2, 3, 4, 4, 4, 5, 6]) if rng.random() > 0.005 else 7
        side = rng.choice([1, -1])
        best = bid if side > 0 else ask
        price = best + rng.choice([0, 0, 0, -side, side if typ in (4, 5) else 0])
        rows.append(dict(
            seq=i, time=t, type=typ, order_id=rng.randrange(1, 40), size=rng.choice([1, 50, 100, 300]), price=price * 100, direction=side,
            bids=[((bid - k) * 100, rng.choice([100, 200, 400])) for k in range(levels)],
            asks=[((ask + k) * 100, rng.choice([100, 200, 400])) for k in range(levels)]))
    return rows


def replay(rows, order, model):
    """One order against the later rows. Returns (qty, fill_seq, end_seq, end_time, reason)."""
    at = rows[order["place_seq"]]
    s, q, size = order["side"], order["price"], order["size"]
    mine = at["bids"] if s > 0 else at["asks"]
    queue = sum(x for p, x in mine if p == q)
    opp0 = at["asks"][0][0] if s > 0 else at["bids"][0][0]
    if s * q >= s * opp0 or s * q < s * mine[-1][0] or size <= 0:
        return 0, None, order["place_seq"], at["time"], "rejected", queue
    end = at["time"] + order["max_wait"]
    left, last, ahead, a, b, behind = size, None, queue, float(queue), 0.0, set()
    for i in range(order["place_seq"] + 1, len(rows)):
        r = rows[i]
        if r["time"] > end:
            return size - left, last, i - 1, end, "timeout", queue
        if r["type"] == 7:
            return size - left, last, i, r["time"], "halt", queue
        here = r["price"] == q and r["direction"] == s
        got = 0
        if r["type"] == 1 and here:
            behind.add(r["order_id"])
            b += r["size"]
        elif r["type"] in (2, 3) and here:
            if r["order_id"] in behind:
                if r["type"] == 3:
                    behind.discard(r["order_id"])
            else:
                ahead = max(0, ahead - r["size"])
            if a + b > 0:
                c, tot = r["size"], a + b
                a, b = max(0.0, a - c * a / tot), max(0.0, b - c * b / tot)
        elif r["type"] in (4, 5):
            if model == "touch" and r["price"] == q:
                got = left
            if r["type"] == 4 and here:
                if model == "fifo":
                    used = min(ahead, r["size"])
                    ahead -= used
                    got = r["size"] - used
                elif model == "l2":
                    used = min(a, float(r["size"]))
                    a -= used
                    got = math.floor(r["size"] - used)
            if s * r["price"] < s * q:
                got = left
        opp = r["asks"][0][0] if s > 0 else r["bids"][0][0]
        if s * q >= s * opp:
            got = left
        got = min(got, left)
        if got > 0:
            left -= got
            last = i
            if left == 0:
                return size, i, i, r["time"], "filled", queue
        own = r["bids"][-1][0] if s > 0 else r["asks"][-1][0]
        if s * q < s * own:
            return size - left, last, i, r["time"], "level_exit", queue
    return size - left, last, len(rows) - 1, rows[-1]["time"], "end_of_data", queue
