"""Colours as cells of a 16-colour terminal: two palette colours mixed by a block character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The palette, dark colours first, and how much of the second colour each character shows.
PALETTE = (
    (0, 0, 0), (212, 26, 26), (34, 211, 39), (211, 211, 48), (28, 15, 210), (214, 32, 211), (46, 212, 213), (201, 201, 201),
    (146, 146, 146), (250, 32, 32), (43, 252, 48), (253, 254, 60), (36, 20, 250), (252, 40, 252), (57, 253, 253), (216, 216, 216),
)
SHARES = (0.0, 0.2, 0.4, 0.7, 1.0)
SHADES = " ░▒▓█"
RESET = "\x1b[0m"


def rgb_of(y: float, cb: float | None = None, cr: float | None = None) -> tuple[float, float, float]:
    """Red, green and blue of DC values; grey without colour differences."""
    light = 128 + y / 8
    clip = lambda v: max(0.0, min(255.0, v))
    if cb is None or cr is None:
        return (clip(light),) * 3
    return clip(light + 1.402 / 8 * cr), clip(light - 0.34414 / 8 * cb - 0.71414 / 8 * cr), clip(light + 1.772 / 8 * cb)


def mixed(rgb: tuple[float, float, float]) -> tuple[int, int, int]:
    """The two nearest palette colours and the character that comes nearest with them."""
    r, g, b = rgb
    apart = lambda x, y, z: sum(((x - r) ** 2, (y - g) ** 2, (z - b) ** 2))
    (_, back), (_, front) = sorted([(apart(*c), i) for i, c in enumerate(PALETTE)])[:2]
    pairs = list(zip(PALETTE[back], PALETTE[front]))
    return back, front, min(range(len(SHARES)), key=lambda i: apart(*[x + (y - x) * SHARES[i] for x, y in pairs]))


def cell(rgb: tuple[float, float, float]) -> str:
    """The escape sequence and character of one cell."""
    back, front, shade = mixed(rgb)
    code = lambda i, dark, bright: dark + i if i < 8 else bright + i - 8
    return f"\x1b[{code(back, 40, 100)}m\x1b[{code(front, 30, 90)}m{SHADES[shade]}"


def nearest_colours(red: Column, green: Column, blue: Column, n: int = 2) -> Column:
    """The n palette colours nearest to a colour, nearest first, of equal ones the lower number."""
    far = lambda c: (F.lit(c[0]) - red) * (F.lit(c[0]) - red) + (F.lit(c[1]) - green) * (F.lit(c[1]) - green) + (F.lit(c[2]) - blue) * (F.lit(c[2]) - blue)
    every = F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(PALETTE)])
    return F.transform(F.slice(F.array_sort(every), 1, n), lambda x: x["i"])
