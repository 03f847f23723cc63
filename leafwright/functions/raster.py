"""Pixels and outlines of tables in numpy: connected parts, smallest rectangles, rules, cells, letterboxes, pixel formats, small image files.

Everything works on one image, that is one table or page.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Least sizes of rules and cells, in pixels and in shares of the image.
LEAST_HEIGHT, LEAST_WIDTH, LEAST_SHARE_V, LEAST_SHARE_H = 30, 50, 0.07, 0.06
CELL_MOST_BOX, CELL_MOST_AREA, CELL_LEAST = 0.75, 0.5, 15.0
WIRED_RATIO = 0.01


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. of the parts of a mask that hang together by sides or corners; 0 outside. Runs of a row are joined to those of the row above."""
    mask = np.asarray(mask, dtype=bool)
    height, width = mask.shape
    if not height or not width:
        return np.zeros(mask.shape, dtype=np.int64)
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]  # exclusive, in the same order
    up = np.arange(len(row))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(row))], dtype=np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1
    out = np.zeros(mask.shape, dtype=np.int64)
    for y, a, b, k in zip(row, start, end, number):
        out[y, a:b] = k
    return out


def component_stats(labels: np.ndarray) -> np.ndarray:
    """label, left, top, width, height, area of each part."""
    y, x = np.nonzero(labels)
    k = labels[y, x]
    n = int(labels.max(initial=0))
    out = np.zeros((n, 6), dtype=np.int64)
    if not n:
        return out
    low, high = np.full((n + 1, 2), np.iinfo(np.int64).max), np.full((n + 1, 2), -1)
    np.minimum.at(low, k, np.stack([x, y], axis=1))
    np.maximum.at(high, k, np.stack([x, y], axis=1))
    out[:, 0], out[:, 1:3], out[:, 3:5], out[:, 5] = np.arange(1, n + 1), low[1:], (high - low + 1)[1:], np.bincount(k, minlength=n + 1)[1:]
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points on its sides."""
    p = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(p) < 3:
        return p

    def half(side: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points; one of its sides lies on the hull."""
    h = hull(points)
    if len(h) == 1:
        return np.repeat(h, 4, axis=0)
    sides = np.roll(h, -1, axis=0) - h
    best, corners = np.inf, None
    for ux, uy in sides / np.hypot(sides[:, 0], sides[:, 1])[:, None]:
        a, b = h @ np.array([ux, uy]), h @ np.array([-uy, ux])
        area = (a.max() - a.min()) * (b.max() - b.min())
        if area < best - 1e-9:
            best = area
            corners = np.array([[p * ux - q * uy, p * uy + q * ux] for p, q in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return corners


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left: the left two by height, of the right two the farther from the top left is at the bottom."""
    p = np.asarray(points, dtype=float)
    p = p[np.argsort(p[:, 0], kind="stable")]
    left = p[:2][np.argsort(p[:2, 1], kind="stable")]
    far = np.hypot(*(p[2:] - left[0]).T)
    bottom = 0 if far[0] > far[1] else 1
    return np.array([left[0], p[3 - bottom], p[2 + bottom], left[1]])


def box_info(corners: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, mean width, mean height and angle of an ordered outline."""
    tl, tr, br, bl = np.asarray(corners, dtype=float)
    cx, cy = np.mean([tl, tr, br, bl], axis=0)
    w = (np.hypot(*(tr - tl)) + np.hypot(*(br - bl))) / 2
    h = (np.hypot(*(tr - br)) + np.hypot(*(tl - bl))) / 2
    square = w * w + h * h
    sine = np.clip((h * (tl[0] - cx) - w * (tl[1] - cy)) * 2 / square, -1, 1) if square > 1e-6 else 0.0
    return float(cx), float(cy), float(w), float(h), float(np.arcsin(sine))


def _outlines(mask: np.ndarray):
    labels = components(mask)
    for k, x, y, w, h, _area in component_stats(labels):
        inside = np.argwhere(labels[y : y + h, x : x + w] == k)[:, ::-1] + (x, y)
        yield w, h, ordered_corners(smallest_rectangle(inside))


def rules(mask: np.ndarray, vertical: bool) -> np.ndarray:
    """Rules x1, y1, x2, y2 in a mask of rule pixels: middle lines of the parts that are long enough."""
    least, share = (LEAST_HEIGHT, LEAST_SHARE_V) if vertical else (LEAST_WIDTH, LEAST_SHARE_H)
    size = mask.shape[0] if vertical else mask.shape[1]
    out = []
    for w, h, (tl, tr, br, bl) in _outlines(mask):
        if (h if vertical else w) <= least:
            continue
        _cx, _cy, width, height, _angle = box_info(np.array([tl, tr, br, bl]))
        a, b = ((tl + tr) / 2, (br + bl) / 2) if width < height else ((tl + bl) / 2, (tr + br) / 2)
        if np.hypot(*(b - a)) >= max(least, share * size):
            out.append([*a, *b])
    return np.array(out, dtype=float).reshape(-1, 4)


def cells(lines: np.ndarray) -> np.ndarray:
    """Outlines (four ordered corners) of the parts between the rules of a table, neither the whole table nor tiny."""
    height, width = lines.shape
    out = []
    for w, h, corners in _outlines(~np.asarray(lines, dtype=bool)):
        if w * h > CELL_MOST_BOX * width * height:
            continue
        _cx, _cy, bw, bh, _angle = box_info(corners)
        if bw * bh < CELL_MOST_AREA * width * height and bw >= CELL_LEAST and bh >= CELL_LEAST:
            out.append(corners)
    return np.array(out, dtype=float).reshape(-1, 4, 2)


def cell_box(corners: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1 around outlines."""
    c = np.asarray(corners, dtype=float).reshape(-1, 4, 2)
    return np.concatenate([c.min(axis=1), c.max(axis=1)], axis=1)


def spans(first_row: int, last_row: int, first_col: int, last_col: int) -> tuple[int, int]:
    """Row and column span of a cell that reaches from one row and column to others, both included."""
    return last_row - first_row + 1, last_col - first_col + 1


def extended(line: np.ndarray, other: np.ndarray, reach: float = 20.0, degrees: float = 30.0) -> np.ndarray:
    """A rule drawn out to meet another that it doesn't touch, by its nearer end, if that is within `reach` and the new rule is level or upright within `degrees`."""
    x1, y1, x2, y2 = line
    a2, b2 = other[3] - other[1], other[0] - other[2]
    c2 = other[2] * other[1] - other[0] * other[3]
    if not (a2 * x1 + b2 * y1 + c2) * (a2 * x2 + b2 * y2 + c2) > 0:
        return line
    a1, b1, c1 = y2 - y1, x1 - x2, x2 * y1 - x1 * y2
    det = a1 * b2 - a2 * b1
    if det == 0:
        return line
    at = np.array([b1 * c2 - b2 * c1, a2 * c1 - a1 * c2]) / det
    ends = np.array([[x1, y1], [x2, y2]])
    gaps = np.hypot(*(ends - at).T)
    if gaps.min() >= reach:
        return line
    near = 0 if gaps[0] < gaps[1] else 1
    keep = ends[1 - near]
    angle = np.degrees(np.arctan(abs((keep[1] - at[1]) / (keep[0] - at[0] + 1e-10))))
    if angle >= degrees and abs(90 - angle) >= degrees:
        return line
    return np.array([*at, *keep] if near == 0 else [*keep, *at])


def joined_rules(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column rules drawn out to each other, pair by pair: later pairs see what earlier ones changed."""
    rows, columns = np.array(rows, dtype=float).reshape(-1, 4), np.array(columns, dtype=float).reshape(-1, 4)
    for i in range(len(rows)):
        for j in range(len(columns)):
            rows[i] = extended(rows[i], columns[j])
            columns[j] = extended(columns[j], rows[i])
    return rows, columns


def opened(mask: np.ndarray, length: int, vertical: bool) -> np.ndarray:
    """What is left of a mask where runs shorter than `length` in one direction are taken out."""
    m = np.asarray(mask, dtype=bool)
    m = m.T if vertical else m
    edges = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out = np.zeros_like(m)
    for y, a, b in zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1]):
        if b - a >= length:
            out[y, a:b] = True
    return out.T if vertical else out


def rule_share(edges: np.ndarray) -> float:
    """Share of the pixels that belong to long level or upright edges, a quarter of the image or more."""
    height, width = edges.shape
    long = opened(edges, max(1, width // 4), False).sum() + opened(edges, max(1, height // 4), True).sum()
    return float(long) / max(1, edges.size)


def is_wired(edges: np.ndarray) -> bool:
    """Whether a table image has rules, from its edge pixels."""
    return rule_share(edges) > WIRED_RATIO


def edge_pixels(grey: np.ndarray, least: float = 100.0) -> np.ndarray:
    """Pixels at which brightness changes by `least` or more over two pixels, in either direction."""
    g = np.asarray(grey, dtype=float)
    out = np.zeros(g.shape, dtype=bool)
    out[:, 1:-1] |= np.abs(g[:, 2:] - g[:, :-2]) >= least
    out[1:-1, :] |= np.abs(g[2:, :] - g[:-2, :]) >= least
    return out


def to_bgr(data: np.ndarray, form: str) -> np.ndarray:
    """Pixels as blue, green, red: from `argb32` (little endian, so blue first), `rgb24`, or one grey channel."""
    d = np.asarray(data, dtype=np.uint8)
    if form == "argb32":
        return d[..., :3].copy()
    if form == "rgb24":
        return d[..., ::-1].copy()
    return np.repeat(d.reshape(*d.shape[:2], -1)[..., :1], 3, axis=2)


def batch_size(known: list[int], size: int) -> int:
    """The one open dimension of a tensor: its size over the product of the known ones; 0 where it doesn't divide."""
    product = int(np.prod([k for k in known if k > 0], dtype=np.int64))
    return size // product if product and size % product == 0 else 0


def png(image: np.ndarray) -> bytes:
    """A PNG file of a grey or BGR image."""
    a = np.asarray(image, dtype=np.uint8)
    a = a if a.ndim == 2 else a[..., ::-1]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(a))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, BMP, JPEG or TIFF file from its header; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return abs(w), abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        e = "<" if data[:1] == b"I" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        found = {}
        for i in range(struct.unpack(e + "H", data[at : at + 2])[0] if at + 2 <= len(data) else 0):
            tag, kind = struct.unpack(e + "HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
            if tag in (256, 257):
                found[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), data[at + 10 + 12 * i : at + (12 if kind == 3 else 14) + 12 * i])[0]
        if len(found) == 2:
            return found[256], found[257]
    return None


def overlay(image: np.ndarray, box: tuple[int, int, int, int], color: tuple[int, int, int], width: int = 2) -> np.ndarray:
    """A copy of an image with the outline of a box drawn in."""
    out = np.array(image, dtype=np.uint8)
    x0, y0, x1, y1 = (max(0, int(v)) for v in box)
    for w in range(width):
        out[y0 + w : y0 + w + 1, x0:x1] = out[max(y1 - w - 1, 0) : max(y1 - w, 0), x0:x1] = color
        out[y0:y1, x0 + w : x0 + w + 1] = out[y0:y1, max(x1 - w - 1, 0) : max(x1 - w, 0)] = color
    return out


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """The part of an image in a box, cut at the image's edges; None where nothing is left."""
    x, y, w, h = int(box[0]), int(box[1]), int(box[2] - box[0]), int(box[3] - box[1])
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, image.shape[1]), min(y + h, image.shape[0])
    return image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None
