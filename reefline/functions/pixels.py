"""Pixel arithmetic on one frame, in numpy. Frames are height x width x 3, blue first.

Edges are thin: a pixel counts where its gradient is the largest across the edge,
and if it is weak, only where a chain of edge pixels joins it to a strong one.
Motion of a frame is followed on a grid of points through smaller and smaller
copies of both frames (sparse pyramidal flow).
"""

from __future__ import annotations

import numpy as np

# Gradients (sum of both directions) of weak and strong edge pixels.
WEAK_EDGE, STRONG_EDGE = 50.0, 150.0
# Spacing of flow points, half the window around one, smaller copies, steps and the step that ends them.
FLOW_GRID, FLOW_REACH, FLOW_LEVELS, FLOW_STEPS, FLOW_END = 20, 10, 3, 30, 0.01
# Mean squared gradient, in the direction where it is least, below which a window shows no motion.
FLOW_TEXTURE = 0.1


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Image bytes to height x width x 3; grey becomes three equal channels, alpha is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


# Weights of blue, green and red in grey, out of 2 ** 14.
GREY_WEIGHTS = (1868, 9617, 4899)


def grey(bgr: np.ndarray) -> np.ndarray:
    i = bgr.astype(np.int64)
    total = sum(i[..., k] * weight for k, weight in enumerate(GREY_WEIGHTS))
    return ((total + 8192) >> 14).astype(np.float64)


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0..180, saturation and value 0..255."""
    f = bgr.astype(np.float64)
    b, g, r = f[..., 0], f[..., 1], f[..., 2]
    v, low = f.max(axis=-1), f.min(axis=-1)
    span = v - low
    safe = np.where(span == 0, 1.0, span)
    hue = np.where(
        v == r, 60 * (g - b) / safe, np.where(v == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe)
    )
    hue = np.where(span == 0, 0.0, np.where(hue < 0, hue + 360, hue))
    s = np.where(v == 0, 0.0, 255 * span / np.where(v == 0, 1.0, v))
    return np.rint(hue / 2), np.rint(s), v


def lightness(bgr: np.ndarray) -> np.ndarray:
    """CIE L of sRGB, scaled to 0..255."""
    f = bgr.astype(np.float64) / 255.0
    linear = np.where(f <= 0.04045, f / 12.92, ((f + 0.055) / 1.055) ** 2.4)
    y = 0.072169 * linear[..., 0] + 0.715160 * linear[..., 1] + 0.212671 * linear[..., 2]
    lab = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.rint(lab * 255 / 100)


def _padded(g: np.ndarray) -> np.ndarray:
    return np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect") if min(
        g.shape
    ) > 1 else np.pad(g, 1, mode="edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _padded(g)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def _slopes(p: np.ndarray, middle: float = 2.0, side: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Slopes along and across the rows of what lies inside the padding."""
    across = p[..., 2:] - p[..., :-2]
    down = p[..., 2:, :] - p[..., :-2, :]
    return (
        side * across[..., :-2, :] + middle * across[..., 1:-1, :] + side * across[..., 2:, :],
        side * down[..., :-2] + middle * down[..., 1:-1] + side * down[..., 2:],
    )


def thin_edges(g: np.ndarray, weak: float = WEAK_EDGE, strong: float = STRONG_EDGE) -> np.ndarray:
    """Edge pixels: gradient maxima across the edge above ``weak`` that touch, in chains, one above ``strong``.

    A gradient within 22.5 degrees of a row or column is compared with its two
    neighbours there, else with the two on its diagonal. Along a row or column
    the later of two neighbours may be equal, so an even edge is one pixel wide.
    """
    h, w = g.shape
    dx, dy = _slopes(np.pad(g, 1, mode="edge"))
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)

    def at(y: int, x: int) -> np.ndarray:
        return around[1 + y : 1 + y + h, 1 + x : 1 + x + w]

    flat = np.abs(dy) < np.abs(dx) * np.tan(np.pi / 8)
    steep = np.abs(dy) > np.abs(dx) * np.tan(3 * np.pi / 8)
    rising = (dx < 0) != (dy < 0)
    peak = np.select(
        [flat, steep, rising],
        [
            (size > at(0, -1)) & (size >= at(0, 1)),
            (size > at(-1, 0)) & (size >= at(1, 0)),
            (size > at(-1, 1)) & (size > at(1, -1)),
        ],
        (size > at(-1, -1)) & (size > at(1, 1)),
    )
    open_ = np.pad(peak & (size > weak), 1)
    edge = open_ & (np.pad(size, 1) > strong)
    front = np.flatnonzero(edge)
    edge, open_ = edge.ravel(), open_.ravel()
    steps = np.array([y * (w + 2) + x for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])
    while len(front):  # what the chains reach next
        near = np.unique((front[:, None] + steps).ravel())
        front = near[open_[near] & ~edge[near]]
        edge[front] = True
    return edge.reshape(h + 2, w + 2)[1:-1, 1:-1]


def _smaller(g: np.ndarray) -> np.ndarray:
    """Every second pixel of each blurred frame."""
    blur = np.array([1, 4, 6, 4, 1]) / 16
    h, w = g.shape[1:]
    p = np.pad(g, [(0, 0), (2, 2), (2, 2)], mode="reflect" if min(h, w) > 2 else "edge")
    rows = sum(b * p[:, k : k + h : 2] for k, b in enumerate(blur))
    return sum(b * rows[:, :, k : k + w : 2] for k, b in enumerate(blur))


def _windows(planes: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values in the window around each point (y, x) of plane ``of``, between pixels too; beyond the border its nearest pixel."""
    _, h, w = planes.shape
    reach = np.arange(-FLOW_REACH, FLOW_REACH + 1)
    y, x = at[:, 0, None] + reach, at[:, 1, None] + reach
    side = np.arange(2 * FLOW_REACH + 2)  # each row and column serves the pixels on both its sides
    y0, x0 = (np.floor(v[:, :1]).astype(np.int64) + side for v in (y, x))
    fy, fx = (y - y0[:, :-1])[:, :, None], (x - x0[:, :-1])[:, None, :]
    line = (of[:, None] * h + np.clip(y0, 0, h - 1)) * w
    seen = planes.ravel()[line[:, :, None] + np.clip(x0, 0, w - 1)[:, None, :]]
    seen = seen[:, :, :-1] * (1 - fx) + seen[:, :, 1:] * fx
    return seen[:, :-1] * (1 - fy) + seen[:, 1:] * fy


def flow(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(y, x) motion of each grid point from one grey frame to the next (see ``flows``)."""
    return flows(before[None], after[None])[0]


def flows(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Frame pair x grid point x (y, x): motion between grey frames of one size, all pairs together.

    At each size, from the smallest, a point moves until its window in the later
    frame looks like the earlier one's. A window without texture keeps what the
    smaller sizes said.
    """
    sizes = [(before, after)]
    for _ in range(FLOW_LEVELS):
        if min(sizes[-1][0].shape[1:]) <= 2 * FLOW_REACH + 1:
            break
        sizes.append((_smaller(sizes[-1][0]), _smaller(sizes[-1][1])))
    grid = np.stack(np.meshgrid(*[np.arange(0, n, FLOW_GRID) for n in before.shape[1:]], indexing="ij"), axis=-1)
    points = grid.reshape(-1, 2).astype(np.float64)
    of = np.repeat(np.arange(len(before)), len(points))
    points = np.tile(points, (len(before), 1))
    moved = np.zeros_like(points)
    for k in reversed(range(len(sizes))):
        old, new = sizes[k]
        at = points / 2**k
        across, down = (s / 32 for s in _slopes(np.pad(old, [(0, 0), (1, 1), (1, 1)], mode="edge"), middle=10.0, side=3.0))
        seen, sx, sy = (_windows(plane, of, at) for plane in (old, across, down))
        xx, xy, yy = ((a * b).sum(axis=(1, 2)) for a, b in ((sx, sx), (sx, sy), (sy, sy)))
        least = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy**2)) / 2 / seen[0].size
        move = moved * 2 if k < len(sizes) - 1 else moved
        open_ = np.flatnonzero(least > FLOW_TEXTURE)
        for _ in range(FLOW_STEPS):
            if not len(open_):
                break
            gap = seen[open_] - _windows(new, of[open_], at[open_] + move[open_])
            bx, by = (gap * sx[open_]).sum(axis=(1, 2)), (gap * sy[open_]).sum(axis=(1, 2))
            det = xx[open_] * yy[open_] - xy[open_] ** 2
            step = np.stack([xx[open_] * by - xy[open_] * bx, yy[open_] * bx - xy[open_] * by], axis=1) / det[:, None]
            move[open_] += step
            inside = ((at[open_] + move[open_] >= 0) & (at[open_] + move[open_] <= np.array(new.shape[1:]) - 1)).all(axis=1)
            open_ = open_[inside & (np.hypot(step[:, 0], step[:, 1]) > FLOW_END)]
        moved = move
    return moved.reshape(len(before), -1, 2)


def gradient(g: np.ndarray) -> np.ndarray:
    """Sobel magnitude."""
    return np.hypot(*_slopes(_padded(g)))


def neighbour_pattern(g: np.ndarray) -> np.ndarray:
    """Per inner pixel: how many of its eight neighbours are at least as bright."""
    if min(g.shape) < 3:
        return np.zeros(0)
    centre = g[1:-1, 1:-1]
    h, w = g.shape
    return sum(
        (g[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] >= centre).astype(np.float64)
        for dy in (-1, 0, 1)
        for dx in (-1, 0, 1)
        if dy or dx
    )


def _area_weights(size: int, target: int) -> np.ndarray:
    """How much of each target pixel each pixel covers, in whole parts: ``size`` parts a target pixel."""
    first, cells = np.arange(target)[:, None] * size, np.arange(size) * target
    return np.clip(np.minimum(first + size, cells + target) - np.maximum(first, cells), 0, None).astype(np.float64)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the covered area, rounded as 8-bit images are.

    One axis after the other: all sums at once cost every pixel once per target
    pixel. The sums are whole numbers, so their order cannot decide a half.
    """
    rows, cols = _area_weights(a.shape[0], height), _area_weights(a.shape[1], width)
    narrow = np.tensordot(rows, a.astype(np.float64), (1, 0))
    total = np.moveaxis(np.tensordot(cols, narrow, (1, 1)), 0, 1)
    return np.rint(total / (a.shape[0] * a.shape[1]))


def difference_bits(bgr: np.ndarray) -> str:
    """64 bits of an 8 x 9 thumbnail: is a pixel brighter than the one to its left."""
    small = grey(area_resize(bgr, 8, 9))
    return "".join("1" if bit else "0" for bit in (small[:, 1:] > small[:, :-1]).ravel())


def motion(before: np.ndarray, after: np.ndarray) -> tuple[float, float]:
    """Motion score of two grey frames, and their mean absolute difference."""
    diff = np.abs(after.astype(np.float64) - before.astype(np.float64))
    share = float(np.mean(diff > 25))
    mean = float(diff.mean())
    return share * 0.6 + mean / 255.0 * 0.3 + float(diff.max()) / 255.0 * 0.1, mean
