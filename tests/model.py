"""The rules of linking and motion, restated row by row in plain Python."""


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b))


def link(faces, least=0.5):
    """faces: (frame, face, embedding); gives their link numbers in the given order."""
    order = sorted(range(len(faces)), key=lambda k: faces[k][:2])
    last, out = [], [0] * len(faces)
    for k in order:
        e = faces[k][2]
        n = next((i for i, x in enumerate(last) if dot(e, x) >= least), len(last))
        last[n : n + 1] = [e]
        out[k] = n
    return out


def direction(a, b, width, least=0.05, change=0.15):
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    dx = (bx1 + bx2) / 2 - (ax1 + ax2) / 2
    side = abs(dx) / width if width > 0 else 0.0
    s, t = (ax2 - ax1) * (ay2 - ay1), (bx2 - bx1) * (by2 - by1)
    depth = (t - s) / ((s + t) / 2 if s + t > 0 else 1.0)
    if side >= least and (abs(depth) < change or side > abs(depth)):
        return ("left-to-right" if dx > 0 else "right-to-left"), min(1.0, side / least * 0.5)
    if abs(depth) >= change:
        return ("towards-camera" if depth > 0 else "away-from-camera"), min(1.0, abs(depth))
    return "stationary", max(0.0, 1.0 - max(side / least, abs(depth) / change))


def motion(rows, width):
    """rows: (frame, face, key, known, link, name, confidence, box) of one sequence; the tracks in order."""
    tracks = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        tracks.setdefault((r[3], r[2]), []).append(r)
    kept = [(k, t) for k, t in tracks.items() if len(t) >= 2]
    kept.sort(key=lambda x: (not x[0][0], x[1][0][4] if not x[0][0] else 0, x[1][0][:2]))
    out = []
    for n, ((_, key), t) in enumerate(kept):
        d, c = direction(t[0][7], t[-1][7], width)
        out.append((n, key, t[0][5], d, round(min(sum(r[6] for r in t) / len(t), c), 9)))
    return out
