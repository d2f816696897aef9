"""Subscripts: parsing and checking."""

from __future__ import annotations


def parse(subscripts: str, n_operands: int) -> tuple[list[str], str]:
    """Input labels and output labels. Without -> the output has every label that occurs once, in order of the alphabet."""
    if "." in subscripts:
        raise ValueError("ellipsis isn't supported")
    left, arrow, right = subscripts.replace(" ", "").partition("->")
    inputs = left.split(",")
    if len(inputs) != n_operands:
        raise ValueError(f"{len(inputs)} subscripts for {n_operands} operands")
    if not arrow:
        right = "".join(sorted(c for c in set(left) if c != "," and left.count(c) == 1))
    return inputs, right


def sizes(inputs: list[str], shapes: list[tuple[int, ...]], more: dict[str, int] | None = None) -> dict[str, int]:
    """Length of each label; labels must agree wherever they occur."""
    out: dict[str, int] = {}
    for labels, shape in zip(inputs, shapes):
        if len(labels) != len(shape):
            raise ValueError(f"labels {labels!r} for {len(shape)} dimensions")
        for c, n in zip(labels, shape):
            if out.setdefault(c, n) != n:
                raise ValueError(f"label {c!r} has lengths {out[c]} and {n}")
    return {**(more or {}), **out}
