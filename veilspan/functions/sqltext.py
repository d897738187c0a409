"""Helpers for composing SQL expression text."""

from __future__ import annotations

_BLOCK = 128


def quoted(text: str) -> str:
    """String literal with escapes for backslash, quote and line breaks."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    A lambda variable is computed once per row, whereas a plain expression
    used inside a higher-order function is computed once per element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_of(value: str) -> str:
    """Pieces of a value between white space, without empty ones."""
    from veilspan.functions.patterns import SPACE

    return f"filter(split({value}, {quoted(f'[{SPACE}]+')}), w -> w <> '')"


def running_sums(steps: str, levels: int = 2) -> str:
    """Inclusive running sums of an integer array.

    Sums of blocks of 128 items come first, and their running sums by the same rule, so n items cost
    about n * 128 additions; past the last level, beyond four million items, they grow faster.
    """
    v, s, starts, i, q, x, j, acc = (f"{name}{levels}" for name in ("v", "s", "starts", "i", "q", "x", "j", "acc"))

    def total(values: str, start: str, stop: str) -> str:
        """Sum of values[start] .. values[stop - 1]; zero for an empty range."""
        span = f"case when {stop} > {start} then sequence({start}, {stop} - 1) else cast(array() as array<int>) end"
        return f"aggregate({span}, 0, ({acc}, {j}) -> {acc} + get({values}, {j}))"

    if not levels:
        sums = f"transform({v}, ({x}, {i}) -> {total(v, '0', f'{i} + 1')})"
        return let(v, steps, sums)
    blocks = f"transform(sequence(0, (size({v}) - 1) div {_BLOCK}), {q} -> {total(v, f'{q} * {_BLOCK}', f'least(({q} + 1) * {_BLOCK}, size({v}))')})"
    before = f"concat(array(0), {running_sums(blocks, levels - 1)})"
    within = f"get({starts}, cast({i} div {_BLOCK} as int)) + {total(v, f'{i} - {i} % {_BLOCK}', f'{i} + 1')}"
    sums = let(starts, before, f"transform({v}, ({x}, {i}) -> {within})")
    return let(v, steps, f"case when size({v}) > 0 then {sums} else {v} end")
