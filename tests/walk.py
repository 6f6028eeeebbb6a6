"""Sequential walks in plain Python, the oracle for history features."""

from collections import defaultdict


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, r[1], r[0]))


def momentum(rows, recent=3):
    streak, last, out = defaultdict(int), defaultdict(list), {}
    for bid, _, red, blue, winner, *_ in ordered(rows):
        values = []
        for name in (red, blue):
            known = name is not None
            hist = [w for w in last[name][-recent:] if w is not None] if known else []
            values += [streak[name] if known else 0, sum(hist) / len(hist) if hist else 0.5]
        out[bid] = tuple(values)
        for name, label in ((red, "Red"), (blue, "Blue")):
            if name is None:
                continue
            won = None if winner is None else int(winner == label)
            if won is not None:
                streak[name] = streak[name] + 1 if won else 0
            last[name].append(won)
    return out


def form(rows, window=5, span=10):
    """(red roll, blue roll, red ewm, blue ewm) per bout; side-specific histories."""
    seen, state, out = defaultdict(list), {}, {}
    alpha = 2 / (span + 1)
    for bid, _, red, blue, _, rx, bx in ordered(rows):
        rolls, ewms = [], []
        for name, side in ((red, "r"), (blue, "b")):
            k = (name, side)
            recent = [v for v in seen[k][-window:] if v is not None] if name is not None else []
            rolls.append(sum(recent) / len(recent) if recent else None)
            ewms.append(state[k][0] if name is not None and k in state else None)
        out[bid] = (*rolls, *ewms)
        for name, side, x in ((red, "r", rx), (blue, "b", bx)):
            if name is None:
                continue
            k = (name, side)
            seen[k].append(x)
            if k in state:
                y, w = state[k]
                w *= 1 - alpha
                state[k] = (y, w) if x is None else ((w * y + alpha * x) / (w + alpha), 1.0)
            elif x is not None:
                state[k] = (x, 1.0)
    return out
