"""What stands before and behind a model: tensors, masks, colour spaces, detections, poses, recognised text; no Spark here.

Images are (height, width, channels) uint8, masks and depths (height, width) float.
"""

from __future__ import annotations

import math

import numpy as np

from .image import resize_lanczos


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels of any image."""
    return image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, 2)


def luma(image: np.ndarray) -> np.ndarray:
    v = rgb(image).astype(float)
    return v[..., 0] * 0.2126 + v[..., 1] * 0.7152 + v[..., 2] * 0.0722


def truncated(values: np.ndarray) -> np.ndarray:
    return np.clip(values, 0, 255).astype(np.uint8)


def nchw(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.transpose(2, 0, 1)[None]).astype(np.float32)


def hwc(tensor: np.ndarray) -> np.ndarray:
    """(h, w, c) of the first image of an NCHW tensor."""
    return np.asarray(tensor, float)[0].transpose(1, 2, 0)


def plane(tensor: np.ndarray) -> np.ndarray:
    """The last two axes of a tensor's first plane."""
    t = np.asarray(tensor, float)
    return t.reshape(-1, *t.shape[-2:])[0]


def resize_plane(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    h, w = values.shape
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, h), (width, w)))
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = values[y0][:, x0] * (1 - fx) + values[y0][:, x1] * fx
    return top * (1 - fy) + (values[y1][:, x0] * (1 - fx) + values[y1][:, x1] * fx) * fy


def box_mean(values: np.ndarray, radius: int) -> np.ndarray:
    """The mean of a square clipped at the edges, by an integral image."""
    h, w = values.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = values.cumsum(0).cumsum(1)
    a, b = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    c, d = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    total = sums[b][:, d] - sums[a][:, d] - sums[b][:, c] + sums[a][:, c]
    return total / ((b - a)[:, None] * (d - c)[None])


def guided(guide: np.ndarray, mask: np.ndarray, radius: int = 15, eps: float = 0.01) -> np.ndarray:
    """The mask led by the guide, both 0..1."""
    mi, mp = box_mean(guide, radius), box_mean(mask, radius)
    a = (box_mean(guide * mask, radius) - mi * mp) / (box_mean(guide * guide, radius) - mi * mi + eps)
    return np.clip(box_mean(a, radius) * guide + box_mean(mp - a * mi, radius), 0, 1)


def apply_mask(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """RGBA with the mask, at the image's size and led by its luma, as alpha."""
    h, w = image.shape[:2]
    mask = guided(luma(image) / 255, resize_plane(np.clip(mask, 0, 1), w, h))
    return np.concatenate([rgb(image), np.floor(mask * 255 + 0.5).astype(np.uint8)[..., None]], 2)


#: sRGB to XYZ, and the white of D65.
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def to_lab(values: np.ndarray) -> np.ndarray:
    """CIE Lab of sRGB in 0..1."""
    linear = np.where(values > 0.04045, ((values + 0.055) / 1.055) ** 2.4, values / 12.92)
    t = linear @ TO_XYZ.T / WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f**3 > 216 / 24389, f**3, (116 * f - 16) / (24389 / 27)) * WHITE
    linear = np.clip(t @ np.linalg.inv(TO_XYZ).T, 0, None)
    return np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)


def colorized(gray: np.ndarray, tensor: np.ndarray, saturation: float) -> np.ndarray:
    """Of luma 0..1 and a model's output: RGB (three planes), ab in units of 128 (two), else gray."""
    out = hwc(tensor)
    if out.shape[2] >= 3:
        return truncated(out[..., :3] * 255)
    if out.shape[2] == 2:
        return truncated(from_lab(np.concatenate([gray[..., None] * 100, out * saturation * 128], 2)) * 255)
    return truncated(np.repeat(gray[..., None], 3, 2) * 255)


def recolored(styled: np.ndarray, original: np.ndarray) -> np.ndarray:
    """The lightness of one image with the colours of another."""
    lab = to_lab(rgb(original) / 255.0)
    lab[..., 0] = to_lab(rgb(styled) / 255.0)[..., 0]
    return truncated(from_lab(lab) * 255 + 0.5)


def blend(a: np.ndarray, b: np.ndarray, strength: float) -> np.ndarray:
    return truncated(a * (1 - strength) + b * strength + 1e-9)


def normalized_depth(depth: np.ndarray, normalize: bool = True, invert: bool = False) -> np.ndarray:
    low, high = float(depth.min()), float(depth.max())
    if normalize and high > low:
        depth, low, high = (depth - low) / (high - low), 0.0, 1.0
    return high - depth + low if invert else depth


def suppressed(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Greedy non-maximum suppression: the rows that stay, best first."""
    order, keep = np.argsort(-scores, kind="stable").tolist(), []
    area = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    for k in order:
        low, high = np.maximum(boxes[keep, :2], boxes[k, :2]), np.minimum(boxes[keep, 2:4], boxes[k, 2:4])
        both = np.prod(np.maximum(0, high - low), 1)
        if not (both / np.maximum(area[keep] + area[k] - both, 1e-12) >= threshold).any():
            keep.append(k)
    return keep


def detections(outputs: list[np.ndarray], sx: float, sy: float, width: int, height: int, least: float, threshold: float, most: int) -> list[dict]:
    """Boxes in an image's own pixels, of outputs boxes (n, 4), scores (n) and perhaps landmarks (n, 10), or one (n, 5 or 15)."""
    parts = [np.asarray(o, float) for o in outputs]
    if len(parts) == 1:
        rows = parts[0].reshape(-1, parts[0].shape[-1])
        boxes, scores, marks = rows[:, :4], rows[:, 4], rows[:, 5:15] if rows.shape[1] >= 15 else None
    else:
        boxes, scores = parts[0].reshape(-1, 4), parts[1].reshape(len(parts[0].reshape(-1, 4)), -1)[:, -1]
        marks = parts[2].reshape(-1, 10) if len(parts) > 2 else None
    some = np.flatnonzero(scores >= least)
    out = []
    for k in some[suppressed(boxes[some], scores[some], threshold)][:most].tolist():
        x1, y1, x2, y2 = boxes[k] * (sx, sy, sx, sy)
        x1, y1, x2, y2 = int(max(0, x1)), int(max(0, y1)), int(min(width, x2)), int(min(height, y2))
        points = [] if marks is None else (marks[k].reshape(5, 2) * (sx, sy)).tolist()
        out.append({"x": x1, "y": y1, "w": max(0, x2 - x1), "h": max(0, y2 - y1), "score": float(scores[k]), "landmarks": points})
    return out


def poses(output: np.ndarray, least: float = 0.3, most: int = 6, joints: int = 17) -> list[dict]:
    """People of an output (1, n, 3 joints + box) or (1, 1, joints, 3): points (x, y, confidence) in 0..1, and their mean confidence."""
    output = np.asarray(output, float)
    if output.shape[-1] == 3:
        people = output.reshape(-1, joints, 3)
    else:
        people = output.reshape(-1, output.shape[-1])[:, : 3 * joints].reshape(-1, joints, 3)
    out = []
    for person in people[:most]:
        confidence = float(person[:, 2].mean())
        if confidence >= least:
            points = [[float(np.clip(x, 0, 1)), float(np.clip(y, 0, 1)), float(c)] for y, x, c in person]
            out.append({"points": points, "confidence": confidence})
    return out


def ctc(logits: np.ndarray, alphabet: str) -> tuple[str, float]:
    """Greedy text of (steps, classes), class 0 blank; its confidence is the mean of the kept steps' greatest values."""
    best, text, values, before = logits.argmax(-1), [], [], -1
    for step, k in zip(logits, best.tolist()):
        if k != before and 0 < k <= len(alphabet):
            text.append(alphabet[k - 1])
            values.append(float(step[k]))
        before = k
    return "".join(text), float(np.mean(values)) if values else 0.0


def ordered_quad(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    total, diff = points.sum(1), points[:, 0] - points[:, 1]
    return points[[total.argmin(), diff.argmax(), total.argmax(), diff.argmin()]]


def rectified(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral as an upright image: bilinear between its edges."""
    h, w = image.shape[:2]
    quad = ordered_quad(np.clip(np.asarray(quad, float).reshape(4, 2), 0, (w - 1, h - 1)))
    side = lambda a, b: math.dist(quad[a], quad[b])
    width = max(1, math.floor(max(side(0, 1), side(3, 2)) + 0.5))
    height = max(1, math.floor(max(side(0, 3), side(1, 2)) + 0.5))
    s, t = np.arange(width) / max(1, width - 1), (np.arange(height) / max(1, height - 1))[:, None, None]
    left, right = quad[0] * (1 - t) + quad[3] * t, quad[1] * (1 - t) + quad[2] * t
    at = left * (1 - s[None, :, None]) + right * s[None, :, None]
    x, y = at[..., 0], at[..., 1]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    return truncated(top * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy + 0.5)


def reading_order(blocks: list[dict], line: int = 20) -> list[dict]:
    """Blocks from top to bottom, those whose tops begin within a line's height of the line's first one from left to right."""
    out: list[dict] = []
    row: list[dict] = []
    for block in sorted(blocks, key=lambda b: (b["y"], b["x"])):
        if row and block["y"] - row[0]["y"] >= line:
            out += sorted(row, key=lambda b: b["x"])
            row = []
        row.append(block)
    return out + sorted(row, key=lambda b: b["x"])


def softmax(values: np.ndarray) -> np.ndarray:
    e = np.exp(values - values.max())
    return e / e.sum()


def fitted(image: np.ndarray, most: int) -> np.ndarray:
    """The image, made smaller where a side is over most."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    return resize_lanczos(image, max(1, w * most // max(h, w)), max(1, h * most // max(h, w)))
