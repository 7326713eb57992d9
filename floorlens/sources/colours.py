"""Colours of drawing entities: indexed palette, true colours, inheritance from layers."""

from __future__ import annotations

#: The first ten indices and the six greys at the end of the drawing format's palette.
NAMED = [(0, 0, 0), (255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 255, 255), (128, 128, 128), (192, 192, 192)]
GREYS = [51, 80, 105, 130, 190, 255]
#: Brightness of an index's last digit, two by two.
LEVELS = [255, 165, 127, 76, 38]
#: Indices that stand for the colour of the insertion and of the layer, and the index where nothing is said.
BY_BLOCK, BY_LAYER, WHITE = 0, 256, 7


def palette(index: int) -> tuple[int, int, int]:
    """The colour of an index from 1 to 255; from 10 on 24 hues of ten shades each, every second one half mixed with white."""
    if index < 10:
        return NAMED[index]
    if index >= 250:
        return (GREYS[index - 250],) * 3
    hue, shade = index // 10 - 1, index % 10

    def part(turn: int) -> int:
        apart = min((hue + turn) % 24, -(hue + turn) % 24)
        full = 255 * min(max(8 - apart, 0), 4) // 4
        if shade % 2:
            full = (full + 255) // 2
        return (2 * LEVELS[shade // 2] * full + 255) // 510

    return part(0), part(16), part(8)


def entity_colour(index: int | None, true_colour: int | None, layer_index: int | None) -> tuple[int, int, int]:
    """An entity's true colour, else that of its index; one by layer or by block has the index of the layer it is shown on."""
    if true_colour is not None:
        return true_colour >> 16 & 255, true_colour >> 8 & 255, true_colour & 255
    if index is None or index in (BY_BLOCK, BY_LAYER):
        index = layer_index
    index = abs(index) if index is not None else WHITE
    return palette(index if 1 <= index <= 255 else WHITE)
