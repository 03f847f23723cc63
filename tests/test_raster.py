"""Pixels and outlines against plain brute force."""

import numpy as np
import pytest

from leafwright.functions import raster as A


def plain_labels(mask):
    out, n = np.zeros(mask.shape, dtype=int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        out[y, x] = n
        while stack:
            a, b = stack.pop()
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and not out[c, d]:
                        out[c, d] = n
                        stack.append((c, d))
    return out


def test_components_match_flood_fill():
    rng = np.random.default_rng(2)
    for p in (0.1, 0.35, 0.5, 0.8):
        for _ in range(25):
            mask = rng.random((rng.integers(1, 14), rng.integers(1, 17))) < p
            a, b = A.components(mask), plain_labels(mask)
            assert (a > 0).tolist() == (b > 0).tolist() and a.max(initial=0) == b.max(initial=0)
            assert len({(x, y) for x, y in zip(a[mask], b[mask])}) == a.max(initial=0)
            for k, left, top, w, h, area in A.component_stats(a):
                y, x = np.nonzero(a == k)
                assert (left, top, w, h, area) == (x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x))


def test_smallest_rectangle_is_no_larger_than_any_turned_one():
    rng = np.random.default_rng(4)
    for _ in range(30):
        p = rng.normal(size=(12, 2)) * (5, 1)
        c = A.smallest_rectangle(p)
        area = np.hypot(*(c[1] - c[0])) * np.hypot(*(c[2] - c[1]))
        for t in np.linspace(0, np.pi / 2, 200):
            q = p @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
            assert area <= np.prod(np.ptp(q, axis=0)) + 1e-6
    assert A.smallest_rectangle(np.array([[3, 4]])).tolist() == [[3, 4]] * 4


def test_corners_and_box_info():
    square = np.array([[0, 0], [10, 0], [10, 4], [0, 4]], dtype=float)
    rng = np.random.default_rng(1)
    for _ in range(10):
        assert A.ordered_corners(rng.permutation(square)).tolist() == square.tolist()
    cx, cy, w, h, _angle = A.box_info(square)
    assert (cx, cy, w, h) == (5, 2, 10, 4)


def drawn(rows, columns, size=(200, 300)):
    m = np.zeros(size, dtype=bool)
    for y in rows:
        m[y : y + 2] = True
    for x in columns:
        m[:, x : x + 2] = True
    return m


def test_rules_and_cells_of_a_drawn_table():
    rows, columns = [0, 60, 120, 198], [0, 100, 200, 298]
    level = A.rules(drawn(rows, []), False)
    assert sorted(round(y) for _x, y, _x2, _y2 in level) == [0, 60, 120, 198] and (level[:, 2] - level[:, 0] > 290).all()
    upright = A.rules(drawn([], columns), True)
    assert len(upright) == 4
    assert len(A.rules(drawn([], columns)[:25], True)) == 0  # too short
    got = A.cell_box(A.cells(drawn(rows, columns)))
    assert len(got) == 9 and sorted({tuple(map(int, (b[0], b[1]))) for b in got})[0] == (2, 2)
    assert len(A.cells(np.zeros((50, 50), dtype=bool))) == 0  # the whole image is no cell
    assert A.spans(1, 3, 0, 0) == (3, 1)


def test_rules_are_drawn_out_in_order():
    row, column = np.array([10.0, 50, 90, 50]), np.array([100.0, 10, 100, 90])
    a, b = A.joined_rules([row], [column])
    assert a[0].tolist() == [10, 50, 100, 50] and b[0].tolist() == column.tolist()
    far = np.array([150.0, 10, 150, 90])
    assert A.extended(row, far).tolist() == row.tolist()
    assert A.extended(row, np.array([50.0, 0, 50, 100])).tolist() == row.tolist()  # they cross already
    assert A.joined_rules([], [column])[0].shape == (0, 4)


def test_wired_tables():
    grey = np.where(drawn([20, 90, 160], [30, 150, 260]), 0, 255)
    assert A.is_wired(A.edge_pixels(grey)) and not A.is_wired(A.edge_pixels(np.full((200, 300), 255)))
    words = np.full((200, 300), 255)
    words[50:58:2, 20:26] = 0
    assert not A.is_wired(A.edge_pixels(words))


def test_pixels_and_files():
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert A.to_bgr(rgb, "rgb24")[0, 0].tolist() == [2, 1, 0]
    assert A.to_bgr(np.arange(32, dtype=np.uint8).reshape(2, 4, 4), "argb32")[0, 1].tolist() == [4, 5, 6]
    assert A.to_bgr(np.array([[7]]), "grey")[0, 0].tolist() == [7, 7, 7]
    assert A.image_size(A.png(rgb)) == (4, 2) and A.image_size(A.png(rgb[..., 0])) == (4, 2)
    assert A.image_size(b"BM" + b"\0" * 16 + (9).to_bytes(4, "little") + (5).to_bytes(4, "little")) == (9, 5)
    assert A.image_size(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x09\x01\x00\x00\x00") == (9, 5)
    assert A.image_size(b"II*\0\x08\0\0\0\x02\0\x00\x01\x03\0\x01\0\0\0\x09\0\0\0\x01\x01\x03\0\x01\0\0\0\x05\0\0\0") == (9, 5)
    assert A.image_size(b"") is None and A.image_size(b"%PDF") is None
    assert A.crop(rgb, (1, 0, 3, 9)).shape == (2, 2, 3) and A.crop(rgb, (9, 9, 12, 12)) is None
    assert A.overlay(np.zeros((10, 10, 3)), (2, 2, 8, 8), (1, 2, 3))[2, 5].tolist() == [1, 2, 3]
    assert A.batch_size([-1, 6], 1800) == 300 and A.batch_size([-1, 7], 1800) == 0


@pytest.mark.parametrize("n", [0, 1])
def test_empty_images(n):
    assert A.component_stats(A.components(np.zeros((n, n)))).shape == (0, 6) and len(A.rules(np.zeros((n, n)), True)) == 0
