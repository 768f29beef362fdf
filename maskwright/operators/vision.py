"""What image models put out, turned to boxes and lines; and QR codes, which need no model.

Images are height x width x 4 arrays of bytes. Models are callables from arrays to arrays, given by the caller.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the models.
TEXT_MEAN, TEXT_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
TEXT_SIDE, TEXT_THRESHOLD, TEXT_BOX, UNCLIP = 960, 0.3, 0.6, 1.5
LINE_HEIGHT, LINE_WIDTH = 48, 1600
FACE_SIDE, FACE_STRIDES, FACE_SCORE, FACE_OVERLAP, FACE_MARGIN = 640, (8, 16, 32), 0.6, 0.3, 0.2

BUDGET_SECONDS = 5.0
ROWS = 16

Box = list[float]


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, pixel centres aligned. What is of one colour stays so; that result can only be read."""
    H, W = img.shape[:2]
    if (w, h) == (W, H):
        return img
    if (img == img[:1, :1]).all():
        return np.broadcast_to(img[:1, :1], (h, w, img.shape[2]))

    def axis(n: int, m: int):
        f = np.maximum(0, (np.arange(n) + 0.5) * m / n - 0.5)
        a = np.minimum(m - 1, np.floor(f).astype(int))
        return a, np.minimum(m - 1, a + 1), f - a

    y0, y1, ty = axis(h, H)
    x0, x1, tx = axis(w, W)
    src = img.astype(float)
    across = src[:, x0] + (src[:, x1] - src[:, x0]) * tx[None, :, None]
    out = np.empty((h, w, img.shape[2]), np.uint8)
    for at in range(0, h, ROWS):  # a few rows at a time, which a core's cache holds
        own = slice(at, at + ROWS)
        first = across[y0[own]]
        part = across[y1[own]]
        part -= first
        part *= ty[own, None, None]
        part += first
        out[own] = np.rint(part, out=part)
    return out


def crop(img: np.ndarray, box: Box) -> np.ndarray:
    x0, y0, x1, y1 = map(int, box)
    return img[y0:y1, x0:x1]


def overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / (area(a) + area(b) - w * h)


def labelled(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in reading order of their first pixel; 0 outside."""
    out = np.zeros(mask.shape, dtype=np.int64)
    out[mask] = np.repeat(*_components(mask)[2:])
    return out


def _components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column, component and length of each run of a mask's rows, in reading order.

    Runs are united with the runs they touch in the row above, all pairs that touch found at once.
    """
    H, W = mask.shape
    flat = np.zeros((H, W + 2), np.int8)
    flat[:, 1:-1] = mask
    edge = np.flatnonzero(np.diff(flat.ravel()))  # each row ends outside, so that runs begin and end in turn
    begin, end = edge[::2], edge[1::2]
    row = begin // (W + 2)
    # a run touches those runs of the row above that begin before it ends and end after it begins
    first, last = np.searchsorted(end, begin - (W + 2), side="right"), np.searchsorted(begin, end - (W + 2), side="left")
    parent = list(range(len(begin)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(last > first).tolist():
        for j in range(first[i], last[i]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    top = np.array([root(x) for x in range(len(parent))], dtype=np.int64)
    return row, begin - row * (W + 2), (np.cumsum(top == np.arange(len(top))))[top], end - begin


def text_input(img: np.ndarray) -> tuple[np.ndarray, float]:
    H, W = img.shape[:2]
    k = min(1.0, TEXT_SIDE / max(W, H))
    small = resize(img, max(1, math.floor(W * k + 0.5)), max(1, math.floor(H * k + 0.5)))
    x = np.zeros((1, 3, -(-small.shape[0] // 32) * 32, -(-small.shape[1] // 32) * 32), np.float32)
    x[0, :, : small.shape[0], : small.shape[1]] = ((small[..., :3] / 255 - TEXT_MEAN) / TEXT_STD).transpose(2, 0, 1)
    return x, k


def text_boxes(prob: np.ndarray, k: float, width: int, height: int) -> list[Box]:
    """Boxes of text from a probability map, widened as the map was shrunk in training, by y then x."""
    mask = prob > TEXT_THRESHOLD
    row, begin, own, length = _components(mask)
    n = int(own.max(initial=0))
    out: list[Box] = []
    if n:
        size, total = np.bincount(own - 1, length, n), np.bincount(np.repeat(own - 1, length), prob[mask], n)
        lo, hi = np.full((n, 2), 1 << 30), np.full((n, 2), -1)
        for d, (least, most) in enumerate(((begin, begin + length - 1), (row, row))):
            np.minimum.at(lo[:, d], own - 1, least)
            np.maximum.at(hi[:, d], own - 1, most)
        for i in range(n):
            w, h = hi[i] - lo[i] + 1
            if w < 3 or h < 3 or total[i] / size[i] < TEXT_BOX:
                continue
            d = w * h * UNCLIP / (2 * (w + h))
            out.append([max(0, math.floor((lo[i, 0] - d) / k)), max(0, math.floor((lo[i, 1] - d) / k)), min(width, math.ceil((hi[i, 0] + 1 + d) / k)), min(height, math.ceil((hi[i, 1] + 1 + d) / k))])
    return sorted(out, key=lambda b: (b[1], b[0]))


def line_input(img: np.ndarray, box: Box) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    part = resize(crop(img, box), max(8, min(LINE_WIDTH, math.ceil(LINE_HEIGHT * w / h))), LINE_HEIGHT)
    return (part[..., :3] / 127.5 - 1).transpose(2, 0, 1)[None].astype(np.float32)


def line_text(prob: np.ndarray, keys: list[str], box: Box) -> dict:
    """text, bbox and extents of characters from class probabilities over time (class 0 is blank): a class is read when
    it is neither blank nor the one before; a character reaches half-way to its neighbours."""
    best = prob.argmax(axis=1)
    at = np.flatnonzero((best != 0) & (best != np.concatenate([[0], best[:-1]])))
    text = "".join(keys[c - 1] if c <= len(keys) else " " for c in best[at])
    mid = box[0] + (at + 0.5) * (box[2] - box[0]) / len(prob)
    edges = np.concatenate([[box[0]], (mid[:-1] + mid[1:]) / 2, [box[2]]]) if len(mid) else np.zeros(1)
    return {"text": text, "bbox": list(map(float, box)), "chars": [[float(a), float(b)] for a, b in zip(edges, edges[1:], strict=False)]}


def read_lines(img: np.ndarray, detect: Callable, recognise: Callable, keys: list[str]) -> list[dict]:
    x, k = text_input(img)
    lines = [line_text(np.asarray(recognise(line_input(img, b)))[0], keys, b) for b in text_boxes(np.asarray(detect(x))[0, 0], k, img.shape[1], img.shape[0])]
    return [x for x in lines if x["text"].strip()]


def face_input(img: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The face model's input and its scale. x: an input of before, which is written over."""
    H, W = img.shape[:2]
    k = FACE_SIDE / max(W, H)
    small = resize(img[..., 2::-1], max(1, math.floor(W * k + 0.5)), max(1, math.floor(H * k + 0.5)))
    h, w = small.shape[:2]
    small = small if any(small.strides[:2]) else small[:1, :1].astype(np.float32)
    x = np.empty((1, 3, FACE_SIDE, FACE_SIDE), np.float32) if x is None else x
    x[0, :, :h, :w] = small.transpose(2, 0, 1)
    x[0, :, h:] = 0
    x[0, :, :h, w:] = 0
    return x, k


def face_boxes(out: dict[str, np.ndarray], k: float, width: int, height: int) -> list[Box]:
    """Boxes of faces from the heads cls, obj and bbox of each stride: decoded, suppressed, widened."""
    found: list[tuple[float, Box]] = []
    for s in FACE_STRIDES:
        n = FACE_SIDE // s
        score = np.sqrt(np.clip(out[f"cls_{s}"].ravel(), 0, 1) * np.clip(out[f"obj_{s}"].ravel(), 0, 1))
        box = out[f"bbox_{s}"].reshape(-1, 4)
        for i in np.flatnonzero(score >= FACE_SCORE):
            cx, cy = (i % n + box[i, 0]) * s, (i // n + box[i, 1]) * s
            w, h = math.exp(box[i, 2]) * s, math.exp(box[i, 3]) * s
            found.append((float(score[i]), [(cx - w / 2) / k, (cy - h / 2) / k, (cx + w / 2) / k, (cy + h / 2) / k]))
    kept: list[Box] = []
    for _, b in sorted(found, key=lambda f: -f[0]):
        if all(overlap(q, b) < FACE_OVERLAP for q in kept):
            kept.append(b)
    wide = lambda b: ((b[2] - b[0]) * FACE_MARGIN, (b[3] - b[1]) * FACE_MARGIN)
    return [[max(0, math.floor(b[0] - wide(b)[0])), max(0, math.floor(b[1] - wide(b)[1])), min(width, math.ceil(b[2] + wide(b)[0])), min(height, math.ceil(b[3] + wide(b)[1]))] for b in kept]


# --- QR codes ---


def finder_runs(dark: np.ndarray) -> list[tuple[int, float, float]]:
    """(y, x, module) where five runs of a row are in the ratio 1:1:3:1:1, dark first."""
    H, W = dark.shape
    edge = np.ones((H, W), bool)
    edge[:, 1:] = dark[:, 1:] != dark[:, :-1]
    begin = np.flatnonzero(edge)
    if len(begin) < 5:
        return []
    length, row = np.diff(np.append(begin, H * W)), begin // W
    at = np.flatnonzero((row[:-4] == row[4:]) & (dark.ravel()[begin[:-4]] == 1))
    five = length[at[:, None] + np.arange(5)]
    whole = five.sum(axis=1)
    m = whole / 7
    ideal = np.array([1, 1, 3, 1, 1])
    fits = (whole >= 7) & (np.abs(five - ideal * m[:, None]) < ideal * m[:, None] * 0.6).all(axis=1)
    at, five, m = at[fits], five[fits], m[fits]
    return list(zip(row[at].tolist(), (begin[at + 2] - row[at] * W + five[:, 2] / 2).tolist(), m.tolist(), strict=True))


def finder_centers(dark: np.ndarray) -> list[tuple[float, float, float]]:
    """(x, y, module) of stacked runs: means over the rows that show them, enough rows for a square of three modules."""
    stacks: list[list[float]] = []
    for y, x, m in finder_runs(dark):
        own = next((s for s in stacks if abs(s[0] - x) < s[2] * 1.5 and abs(s[1] - y) < s[2] * 3 and max(s[2] / m, m / s[2]) < 1.5), None)
        if own is None:
            stacks.append([x, y, m, 1])
        else:
            n = own[3]
            own[:] = [(own[0] * n + x) / (n + 1), (own[1] * n + y) / (n + 1), (own[2] * n + m) / (n + 1), n + 1]
    return [(s[0], s[1], s[2]) for s in stacks if s[3] >= max(2, s[2] * 1.5)]


def find_codes(img: np.ndarray) -> list[Box]:
    """Boxes of QR codes: three finder patterns at the corners of a square, whose fourth corner completes it."""
    H, W = img.shape[:2]
    dark = (img[..., :3] @ np.array([0.299, 0.587, 0.114]) < 128).astype(np.int8)
    spots = finder_centers(dark)
    used: set[int] = set()
    out: list[Box] = []
    n = len(spots)
    for trio in ((i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)):
        if used & set(trio):
            continue
        p = np.array([spots[t][:2] for t in trio])
        ms = [spots[t][2] for t in trio]
        if max(ms) / min(ms) > 1.5:
            continue
        corner = max(range(3), key=lambda c: math.dist(p[(c + 1) % 3], p[(c + 2) % 3]))
        b, c = p[(corner + 1) % 3], p[(corner + 2) % 3]
        short, long = sorted((math.dist(p[corner], b), math.dist(p[corner], c)))
        if short < 7 * min(ms) or long / short > 1.25 or abs(math.dist(b, c) / (short * math.sqrt(2)) - 1) > 0.15:
            continue
        corners = np.vstack([p, b + c - p[corner]])
        pad = 4.5 * max(ms)
        (x0, y0), (x1, y1) = np.floor(corners.min(0) - pad), np.ceil(corners.max(0) + pad)
        box = [max(0, int(x0)), max(0, int(y0)), min(W, int(x1)), min(H, int(y1))]
        if any(o[0] < box[2] and box[0] < o[2] and o[1] < box[3] and box[1] < o[3] for o in out):
            continue
        out.append(box)
        used |= set(trio)
    return out


def protobuf_strings(raw: bytes, field: int = 14, key: str = "character") -> list[str]:
    """The lines under a key of a model's metadata (repeated messages of key 1 and value 2 in the given field)."""

    def varint(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            b = raw[at]
            value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            tag, at = varint(at)
            kind = tag & 7
            if kind == 2:
                n, at = varint(at)
                yield tag >> 3, at, at + n
                at += n
            elif kind == 0:
                _, at = varint(at)
            else:
                at += 8 if kind == 1 else 4

    for f, a, b in fields(0, len(raw)):
        if f == field:
            entry = {g: raw[x:y].decode("utf-8", "replace") for g, x, y in fields(a, b)}
            if entry.get(1) == key:
                return entry[2].split("\n")
    raise ValueError("no character list in the model")


def analyse(images: DataFrame, models: Callable[[], dict] | None = None, seconds: float = BUDGET_SECONDS) -> DataFrame:
    """images (snapshot_id, key, png, analysed) -> ok, faces, codes, lines and error of each.

    models: makes {faces, detect, recognise, keys} once for each worker. Without it, or where it or an image fails, the
    result isn't ok, and the image is masked as a whole. So it is where the images of its snapshot before it took more than
    `seconds`: the images of a snapshot share a task. The array that faces gets is written over for the next image.
    """
    from ..sources.png import decode_png

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict | None = None
        x: np.ndarray | None = None
        spent: dict[str, float] = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                began = time.monotonic()
                try:
                    if not r.analysed:
                        raise ValueError("too many images on screen")
                    if spent.get(r.snapshot_id, 0.0) > seconds:
                        raise ValueError("time budget exceeded")
                    if made is None:
                        if models is None:
                            raise ValueError("models unavailable")
                        made = models()
                    img = decode_png(r.png)
                    if min(img.shape[:2]) < 8:
                        raise ValueError("off screen")
                    x, k = face_input(img, x)
                    faces = face_boxes(made["faces"](x), k, img.shape[1], img.shape[0])
                    out.append((r.snapshot_id, r.key, True, faces, find_codes(img), read_lines(img, made["detect"], made["recognise"], made["keys"]), None))
                except Exception as e:  # fail closed
                    out.append((r.snapshot_id, r.key, False, [], [], [], str(e)))
                spent[r.snapshot_id] = spent.get(r.snapshot_id, 0.0) + time.monotonic() - began
            yield pd.DataFrame(out, columns=["snapshot_id", "key", "ok", "faces", "codes", "lines", "error"])

    from ..sources.wire import VISION

    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that few bytes don't end in one task
    return images.select("snapshot_id", "key", "png", "analysed").repartition(parts, "snapshot_id").sortWithinPartitions("snapshot_id", "key").mapInPandas(run, VISION)


def read_back(images: DataFrame, models: Callable[[], dict] | None = None) -> DataFrame:
    """id and audit of outgoing images (id, png): the lines that can still be read in them, null where reading failed, so
    that the firewall refuses what it could not read."""
    from ..sources.png import decode_png

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict | None = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    made = made or models()
                    out.append((r.id, [x["text"] for x in read_lines(decode_png(r.png), made["detect"], made["recognise"], made["keys"])]))
                except Exception:  # fail closed
                    out.append((r.id, None))
            yield pd.DataFrame(out, columns=["id", "audit"])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "png").mapInPandas(run, f"id {kind}, audit array<string>")
