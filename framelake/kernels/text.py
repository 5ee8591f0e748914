"""Text on images with a bitmap font of five by seven dots, scaled by repetition; no Spark here."""

from __future__ import annotations

import numpy as np

#: The dots of the printable ASCII characters, two hex digits a column, the lowest bit on top.
GLYPHS = {
    " ": "0000000000", "!": "00005F0000", '"': "0007000700", "#": "147F147F14", "$": "242A7F2A12",
    "%": "2313086462", "&": "3649562050", "'": "0000070000", "(": "001C224100", ")": "0041221C00",
    "*": "2A1C7F1C2A", "+": "08083E0808", ",": "0050300000", "-": "0808080808", ".": "0060600000",
    "/": "2010080402", "0": "3E5149453E", "1": "00427F4000", "2": "4261514946", "3": "2141454B31",
    "4": "1814127F10", "5": "2745454539", "6": "3C4A494930", "7": "0171090503", "8": "3649494936",
    "9": "064949291E", ":": "0036360000", ";": "0056360000", "<": "0814224100", "=": "1414141414",
    ">": "0041221408", "?": "0201510906", "@": "324979413E", "A": "7E1111117E", "B": "7F49494936",
    "C": "3E41414122", "D": "7F4141221C", "E": "7F49494941", "F": "7F09090901", "G": "3E4149497A",
    "H": "7F0808087F", "I": "00417F4100", "J": "2040413F01", "K": "7F08142241", "L": "7F40404040",
    "M": "7F020C027F", "N": "7F0408107F", "O": "3E4141413E", "P": "7F09090906", "Q": "3E4151215E",
    "R": "7F09192946", "S": "4649494931", "T": "01017F0101", "U": "3F4040403F", "V": "1F2040201F",
    "W": "3F4038403F", "X": "6314081463", "Y": "0708700807", "Z": "6151494543", "[": "007F414100",
    "\\": "0204081020", "]": "0041417F00", "^": "0402010204", "_": "4040404040", "`": "0001020400",
    "a": "2054545478", "b": "7F48444438", "c": "3844444420", "d": "384444487F", "e": "3854545418",
    "f": "087E090102", "g": "0C5252523E", "h": "7F08040478", "i": "00447D4000", "j": "2040443D00",
    "k": "7F10284400", "l": "00417F4000", "m": "7C04180478", "n": "7C08040478", "o": "3844444438",
    "p": "7C14141408", "q": "081414187C", "r": "7C08040408", "s": "4854545420", "t": "043F444020",
    "u": "3C4040207C", "v": "1C2040201C", "w": "3C4030403C", "x": "4428102844", "y": "0C5050503C",
    "z": "4464544C44", "{": "0008364100", "|": "00007F0000", "}": "0041360800", "~": "1008081008",
}
WIDE, TALL = 6, 8
#: Shares of the free width and height that stand before the text, by anchor.
ANCHORS = {f"{v}-{h}": (x, y) for v, y in (("top", 0.0), ("middle", 0.5), ("bottom", 1.0)) for h, x in (("left", 0.0), ("center", 0.5), ("right", 1.0))}


def dots(text: str) -> np.ndarray:
    """A (rows, columns) mask of lines of text; a character without a glyph is a box."""
    lines = text.split("\n")
    out = np.zeros((TALL * len(lines), WIDE * max(map(len, lines), default=0)), bool)
    for j, line in enumerate(lines):
        for k, c in enumerate(line):
            columns = bytes.fromhex(GLYPHS.get(c, "7F4141417F"))
            for x, column in enumerate(columns):
                for y in range(7):
                    out[j * TALL + y, k * WIDE + x] = column >> y & 1
    return out


def wrapped(text: str, columns: int) -> str:
    """Lines of at most so many characters, broken at spaces where there are any."""
    out = []
    for line in text.split("\n"):
        words, now = line.split(" "), ""
        for word in words:
            while len(word) > columns:
                if now:
                    out.append(now)
                    now = ""
                out.append(word[:columns])
                word = word[columns:]
            if now and len(now) + 1 + len(word) > columns:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        out.append(now)
    return "\n".join(out)


def paint(image: np.ndarray, mask: np.ndarray, x: int, y: int, color: tuple[int, ...], opacity: float = 1.0) -> None:
    """Blends a colour into the image, in place, where the mask is set; what stands outside is cut off."""
    h, w = image.shape[:2]
    a, b, c, d = max(0, y), min(h, y + mask.shape[0]), max(0, x), min(w, x + mask.shape[1])
    if a >= b or c >= d:
        return
    hit = mask[a - y : b - y, c - x : d - x]
    n = min(image.shape[2], 3)
    part = image[a:b, c:d, :n]
    shade = np.array((*color, *color[-1:] * 3)[:n] if image.shape[2] >= 3 else [sum(color[:3]) // len(color[:3])], float)
    part[hit] = np.floor(part[hit] * (1 - opacity) + shade * opacity + 0.5).astype(np.uint8)
    if image.shape[2] in (2, 4):
        alpha = image[a:b, c:d, -1]
        alpha[hit] = np.maximum(alpha[hit], int(255 * opacity))


def draw_text(image: np.ndarray, text: str, x: int = 0, y: int = 0, size: int = 8, color=(255, 255, 255), anchor: str | None = None, margin: int = 0, background=None, outline=None, opacity: float = 1.0, columns: int = 0) -> np.ndarray:
    """The image with text of about size pixels a line at (x, y), or at an anchor such as bottom-center with a margin."""
    out, scale = image.copy(), max(1, round(size / TALL))
    if columns < 0 or not 0 <= opacity <= 1 or anchor is not None and anchor not in ANCHORS:
        raise ValueError("bad text settings")
    mask = np.kron(dots(wrapped(text, columns) if columns else text), np.ones((scale, scale), bool)).astype(bool)
    if anchor:
        sx, sy = ANCHORS[anchor]
        x, y = (round(margin + s * (n - m - 2 * margin)) for s, n, m in ((sx, image.shape[1], mask.shape[1]), (sy, image.shape[0], mask.shape[0])))
    if background is not None:
        paint(out, np.ones((mask.shape[0] + 2 * scale, mask.shape[1] + 2 * scale), bool), x - scale, y - scale, background, opacity)
    if outline is not None:
        for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            paint(out, mask, x + dx * scale, y + dy * scale, outline, opacity)
    paint(out, mask, x, y, color, opacity)
    return out
