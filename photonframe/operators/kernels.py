"""Neighbourhood kernels on float arrays (numpy). Borders reflect about the outermost pixels; every kernel says how far it reaches."""

from __future__ import annotations

import numpy as np


def gaussian_reach(sigma: float) -> int:
    return max(1, int(np.ceil(4 * sigma)))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur of an array that is `gaussian_reach` larger on all sides than the result."""
    r = gaussian_reach(sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    rows = sum(k[i] * a[i : a.shape[0] - 2 * r + i] for i in range(2 * r + 1))
    return sum(k[i] * rows[:, i : a.shape[1] - 2 * r + i] for i in range(2 * r + 1))


def _stack(a: np.ndarray, r: int, step: int = 1) -> np.ndarray:
    """The (2 r + 1) squared shifted views, in steps of `step` pixels."""
    reach = r * step
    h, w = a.shape[0] - 2 * reach, a.shape[1] - 2 * reach
    return np.stack([a[reach + dy * step : reach + dy * step + h, reach + dx * step : reach + dx * step + w] for dy in range(-r, r + 1) for dx in range(-r, r + 1)])


def median(a: np.ndarray, r: int) -> np.ndarray:
    return np.median(_stack(a, r), axis=0)


def maximum(a: np.ndarray, r: int) -> np.ndarray:
    return _stack(a, r).max(axis=0)


def minimum(a: np.ndarray, r: int) -> np.ndarray:
    return _stack(a, r).min(axis=0)


def same_colour_repair(a: np.ndarray, threshold: float) -> np.ndarray:
    """Sites of a colour mosaic above the median of their eight same-colour neighbours by `threshold` take that median. Reach 2."""
    around = np.delete(_stack(a, 1, 2), 4, axis=0)
    middle = np.median(around, axis=0)
    own = a[2:-2, 2:-2]
    return np.where(own - middle > threshold, middle, own)


def bilinear_demosaic(a: np.ndarray, channels: np.ndarray, want: int) -> np.ndarray:
    """Channel `want` at every site: the mean of the 3 by 3 sites of that channel weighted 1, 2, 4. Reach 1."""
    weight = np.array([1, 2, 1, 2, 4, 2, 1, 2, 1], float)[:, None, None]
    held = _stack((channels == want).astype(float), 1) * weight
    return (held * _stack(a, 1)).sum(axis=0) / np.maximum(held.sum(axis=0), 1e-12)


def immerkaer_noise(a: np.ndarray) -> float:
    """Noise from the mean absolute Laplacian difference. Reach 1."""
    k = np.array([1, -2, 1, -2, 4, -2, 1, -2, 1], float)[:, None, None]
    return float(np.sqrt(np.pi / 2) / 6 * np.abs((_stack(a, 1) * k).sum(axis=0)).mean())


def richardson_lucy(a: np.ndarray, psf: np.ndarray, rounds: int) -> np.ndarray:
    """Deconvolution of a tile by a small kernel, through FFTs; the halo absorbs the wrap-around."""
    size = [n + k - 1 for n, k in zip(a.shape, psf.shape)]
    f = np.fft.rfft2(psf / psf.sum(), size)
    cut = tuple(slice(k // 2, k // 2 + n) for n, k in zip(a.shape, psf.shape))
    forward = lambda x, g: np.fft.irfft2(np.fft.rfft2(x, size) * g, size)[cut]
    back = np.fft.rfft2(psf[::-1, ::-1] / psf.sum(), size)
    x = np.maximum(a, 1e-12)
    for _ in range(rounds):
        x = x * forward(a / np.maximum(forward(x, f), 1e-12), back)
    return x


def fourier_shift(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Band-limited shift."""
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real


def stars(a: np.ndarray, r: int, threshold: float) -> list[tuple[int, int, float, float, float, float, float]]:
    """(y, x, cy, cx, flux, fwhm, ellipticity) of local maxima above the median by `threshold` MAD sigma. Reach `r`; positions
    count from the first pixel within the reach."""
    core = a[r:-r, r:-r]
    sky = np.median(core)
    sigma = 1.4826 * np.median(np.abs(core - sky)) or 1e-9
    peak = (core == maximum(a, r)) & (core > sky + threshold * sigma)
    out = []
    gy, gx = np.mgrid[-r : r + 1, -r : r + 1]
    for y, x in zip(*np.nonzero(peak)):
        w = np.maximum(a[y : y + 2 * r + 1, x : x + 2 * r + 1] - sky, 0)
        total = w.sum()
        cy, cx = (w * gy).sum() / total, (w * gx).sum() / total
        yy, xx, xy = (w * (gy - cy) ** 2).sum() / total, (w * (gx - cx) ** 2).sum() / total, (w * (gy - cy) * (gx - cx)).sum() / total
        spread = np.sqrt(max(0.0, ((yy - xx) / 2) ** 2 + xy**2))
        major, minor = np.sqrt((yy + xx) / 2 + spread), np.sqrt(max(0.0, (yy + xx) / 2 - spread))
        out.append((int(y), int(x), float(y + cy), float(x + cx), float(total), float(2.3548 * np.sqrt((yy + xx) / 2)), float(1 - minor / max(major, 1e-9))))
    return out


def mm_restore(y: np.ndarray, var: np.ndarray, mask: np.ndarray, kernels: np.ndarray, rounds: int = 40, kappa: float = 2.0, delta: float | None = 2.0, epsilon: float = 1e-4) -> tuple[np.ndarray, int]:
    """Multiplicative multi-frame restoration of exposures (t, y, x) with kernels (t, k, k): the image and the rounds taken.

    Each round multiplies by sum H'W y / sum H'W H x, clipped to [1/kappa, kappa]; W is the inverse variance, lowered for residuals beyond
    `delta` sigma. It stops when the mean factor, where the exposures reach, settles within `epsilon`.
    """
    half = [k // 2 for k in kernels.shape[1:]]
    with np.errstate(all="ignore"):
        good = np.where(mask, y, np.nan)
        x = np.nan_to_num(np.nanmedian(good, axis=0) if np.isfinite(good).any() else np.zeros(y.shape[1:]))
    # The image extends beyond the exposures by half a kernel, so that light from outside need not be put inside.
    border = ((half[0], half[0]), (half[1], half[1]))
    own = (slice(half[0], half[0] + y.shape[1]), slice(half[1], half[1] + y.shape[2]))
    x = np.pad(x, border, mode="edge")
    y, var, mask = (np.pad(v, ((0, 0), *border), constant_values=c) for v, c in ((y, 0.0), (var, 1.0), (mask, False)))
    size = [n + k - 1 for n, k in zip(y.shape[1:], kernels.shape[1:])]
    cut = (slice(None), slice(half[0], half[0] + y.shape[1]), slice(half[1], half[1] + y.shape[2]))
    kernels = kernels / kernels.sum(axis=(1, 2), keepdims=True)
    f, b = np.fft.rfft2(kernels, size), np.fft.rfft2(kernels[:, ::-1, ::-1], size)
    forward = lambda x: np.fft.irfft2(np.fft.rfft2(x, size)[None] * f, size)[cut]
    adjoint = lambda r: np.fft.irfft2(np.fft.rfft2(r, size) * b, size)[cut].sum(axis=0)
    w0 = np.where(mask, 1 / np.maximum(var, 1e-18), 0.0)
    reach = adjoint(mask.astype(float)) / len(y) > 0.1
    floor = max(1e-9, float(np.percentile(x, 5)) * 1e-3)
    x = np.where(x > floor, x, floor)
    before = None
    for k in range(1, rounds + 1):
        model = forward(x)
        w = w0
        if delta is not None:
            z = np.abs(y - model) * np.sqrt(w0)
            w = w0 * np.where(z <= delta, 1.0, delta / np.maximum(z, 1e-12))
        u = np.clip(np.maximum(adjoint(w * np.where(mask, y, 0)), 0) / np.maximum(adjoint(w * model), 1e-18), 1 / kappa, kappa)
        u = np.where(reach, u, 1.0)
        x = x * u
        now = float(u[reach].mean()) if reach.any() else 1.0
        if before is not None and abs(now / before - 1) < epsilon:
            return x[own], k
        before = now
    return x[own], rounds


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int]:
    """(y0, x0, h, w) of the largest rectangle of true cells; the first found wins ties."""
    heights, best = np.zeros(mask.shape[1] + 1, int), (0, 0, 0, 0)
    for y, row in enumerate(mask):
        heights[:-1] = np.where(row, heights[:-1] + 1, 0)
        open_: list[tuple[int, int]] = []
        for x, h in enumerate(heights):
            start = x
            while open_ and open_[-1][1] >= h:
                start, tall = open_.pop()
                if tall * (x - start) > best[2] * best[3]:
                    best = (y - tall + 1, start, tall, x - start)
            open_.append((start, int(h)))
    return best


def ssim(a: np.ndarray, b: np.ndarray, span: float, sigma: float = 1.5) -> float:
    """Mean structural similarity with a Gaussian window; the reach of the window is cut off."""
    g = lambda x: gaussian(x, sigma)
    ma, mb = g(a), g(b)
    va, vb, vab = g(a * a) - ma**2, g(b * b) - mb**2, g(a * b) - ma * mb
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float(((2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def matching_kernel(sharp: np.ndarray, seen: np.ndarray, weight: np.ndarray, half: int) -> tuple[np.ndarray, float, float]:
    """(kernel, offset, chi2): the kernel that best turns `sharp` (larger by `half` on all sides) into `seen`, and the weighted mean
    squared residual."""
    views = np.concatenate((_stack(sharp, half).reshape((2 * half + 1) ** 2, -1), np.ones((1, seen.size))))
    w = weight.ravel()
    normal = (views * w) @ views.T
    solved = np.linalg.solve(normal + 1e-9 * np.trace(normal) / len(normal) * np.eye(len(normal)), (views * w) @ seen.ravel())
    chi2 = float((w * (seen.ravel() - solved @ views) ** 2).sum() / max(1, np.count_nonzero(w)))
    return solved[:-1].reshape(2 * half + 1, -1), float(solved[-1]), chi2


def match_similarity(a: np.ndarray, b: np.ndarray, n: int = 30, tolerance: float = 2.0) -> np.ndarray | None:
    """A 2 by 3 similarity (scale, rotation, shift, either parity) that maps points a onto b, brightest first; null if no pattern agrees.

    Pairs of the brightest points vote: each pair of a and of b with about equal length gives a transform, judged by how many
    points it brings within `tolerance` of others.
    """
    a, b = np.asarray(a, float)[:n], np.asarray(b, float)[:n]
    best, found = 2, None
    complex_ = lambda p, flip: p[:, 0] + 1j * (-p[:, 1] if flip else p[:, 1])
    zb = complex_(b, False)
    few_a, few_b = min(12, len(a)), min(12, len(b))
    for flip in (False, True):
        za = complex_(a, flip)
        for i in range(few_a):
            for j in range(few_a):
                if i == j:
                    continue
                for k in range(few_b):
                    m = (np.delete(zb[:few_b], k) - zb[k]) / (za[j] - za[i])
                    for turn in m[(np.abs(m) > 0.5) & (np.abs(m) < 2)]:
                        moved = turn * (za - za[i]) + zb[k]
                        hits = int((np.abs(moved[:, None] - zb[None]).min(axis=1) < tolerance).sum())
                        if hits > best:
                            best, s = hits, -1.0 if flip else 1.0
                            shift = zb[k] - turn * za[i]
                            found = np.array([[turn.real, -turn.imag * s, shift.real], [turn.imag, turn.real * s, shift.imag]])
                if best >= 0.8 * min(len(a), len(b)) and best > 3:
                    return found
    return found


def png(pixels: np.ndarray) -> bytes:
    """A PNG of (y, x, 3) or (y, x) arrays of uint8 or uint16."""
    import struct
    import zlib

    a = pixels if pixels.ndim == 3 else pixels[..., None]
    depth = 8 * a.dtype.itemsize
    raw = a.astype(">u2" if depth == 16 else np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in raw)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 2 if a.shape[2] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def separable(a: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Correlation with a kernel over rows and one over columns, both of 2 r + 1 values; the result is r smaller on all sides."""
    r = len(rows) // 2
    b = sum(rows[i] * a[i : a.shape[0] - 2 * r + i] for i in range(2 * r + 1))
    return sum(columns[i] * b[:, i : a.shape[1] - 2 * r + i] for i in range(2 * r + 1))


def local_linear(a: np.ndarray, sigma: float) -> np.ndarray:
    """At every pixel the value there of the plane fitted to its neighbourhood with Gaussian weights; pixels that are not numbers have no weight,
    and where nothing weighs the result is none. Reach `gaussian_reach`."""
    r = gaussian_reach(sigma)
    d = np.arange(-r, r + 1) / max(sigma, 1.0)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    known = np.isfinite(a)
    one, v = known.astype(float), np.where(known, a, 0.0)
    k = (g, g * d, g * d * d)
    s, sx, sy = separable(one, k[0], k[0]), separable(one, k[0], k[1]), separable(one, k[1], k[0])
    sxx, sxy, syy = separable(one, k[0], k[2]), separable(one, k[1], k[1]), separable(one, k[2], k[0])
    t, tx, ty = separable(v, k[0], k[0]), separable(v, k[0], k[1]), separable(v, k[1], k[0])
    # The constant term of the 3 x 3 system, with a small ridge where samples lie on a line.
    ridge = 1e-9 * np.maximum(s, 1e-12)
    s0, sxx, syy = s + ridge, sxx + ridge, syy + ridge
    c0, c1, c2 = sxx * syy - sxy * sxy, sxy * sy - sx * syy, sx * sxy - sxx * sy
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(s > 1e-6, (t * c0 + tx * c1 + ty * c2) / (s0 * c0 + sx * c1 + sy * c2), np.nan)


def starlet(a: np.ndarray, scales: int) -> list[np.ndarray]:
    """Planes of the isotropic undecimated wavelet with the cubic B-spline, finest first, and the smooth rest; `starlet_reach` smaller than `a`
    on all sides. They sum to the image: exactly, if its values are whole numbers below 2^20 and there are up to four scales."""
    spline = np.array([1, 4, 6, 4, 1]) / 16
    out, now = [], np.asarray(a, float)
    for j in range(scales):
        holes = np.zeros(4 * 2**j + 1)
        holes[:: 2**j] = spline
        smooth = separable(now, holes, holes)
        r = 2 * 2**j
        out.append(now[r:-r, r:-r] - smooth)
        now = smooth
    cut = lambda w: w[(w.shape[0] - now.shape[0]) // 2 : (w.shape[0] + now.shape[0]) // 2, (w.shape[1] - now.shape[1]) // 2 : (w.shape[1] + now.shape[1]) // 2]
    return [cut(w) for w in out] + [now]


def starlet_reach(scales: int) -> int:
    return 2 * (2**scales - 1)


def nearest_in_row(height: np.ndarray) -> np.ndarray:
    """For each place of a row the place q with the least (x - q)^2 + height[q]^2, the first of equals; -1 if no height is a number. The lower
    envelope of the parabolas over the row, in linear time."""
    places = np.flatnonzero(np.isfinite(height))
    if not len(places):
        return np.full(len(height), -1)
    f = (height[places] ** 2 + places.astype(float) ** 2).tolist()
    at = places.tolist()
    hull, edges = [0], [-np.inf]
    for k in range(1, len(at)):
        while True:
            j = hull[-1]
            meet = (f[k] - f[j]) / (2.0 * (at[k] - at[j]))
            if meet > edges[-1]:
                break
            hull.pop()
            edges.pop()
        hull.append(k)
        edges.append(meet)
    # At a meeting point both are equally near, and the first one stays.
    return places[np.array(hull)[np.searchsorted(np.array(edges), np.arange(len(height)), "left") - 1]]


def regions(mask: np.ndarray) -> np.ndarray:
    """Labels of the connected regions (pixels that share a side) of a mask: the place of a region's first pixel, -1 outside. Union of the runs
    of each row with those of the row before."""
    h, w = mask.shape
    out = np.full((h, w), -1)
    parent: list[int] = []
    first: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    spans = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        now, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(parent)
            parent.append(i)
            first.append(y * w + a)
            while k < len(before) and before[k][1] <= a:
                k += 1
            j = k
            while j < len(before) and before[j][0] < b:
                p, q = root(before[j][2]), root(i)
                parent[max(p, q)] = min(p, q)
                j += 1
            now.append((a, b, i))
            spans.append((y, a, b, i))
        before = now
    for y, a, b, i in spans:
        out[y, a:b] = first[root(i)]
    return out
