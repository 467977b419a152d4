"""Block sizes of the levels of a transform, checked once on the driver."""

from __future__ import annotations


def level_plan(bsize: int | list[int], depth: int, multilevel: bool = True) -> list[int]:
    """Block sizes, finest first. ``bsize`` as a list is coarsest first and ends with the finest.

    A single size is repeated until the root (multilevel) or used once. A list
    may stop short of the root, which leaves several lowest coefficients.
    """
    sizes = [bsize] if isinstance(bsize, int) else list(bsize)
    for b in sizes:
        if b < 2 or b & (b - 1):
            raise ValueError(f"block size {b} is not a power of two above 1")
    bits = [b.bit_length() - 1 for b in sizes]
    if isinstance(bsize, int):
        if not multilevel:
            return sizes
        if depth % bits[0]:
            raise ValueError(f"depth {depth} is not a multiple of log2({bsize})")
        return sizes * (depth // bits[0])
    if sum(bits) > depth:
        raise ValueError(f"the levels take {sum(bits)} bits, more than the depth {depth}")
    return sizes[::-1]


def spans(sizes: list[int], most: int = 8) -> list[list[int]]:
    """Runs of levels whose product is at most ``most`` (or one level): each runs inside one grouped call."""
    out: list[list[int]] = []
    for b in sizes:
        product = b
        for x in out[-1] if out else []:
            product *= x
        if out and product <= most:
            out[-1].append(b)
        else:
            out.append([b])
    return out
