"""Sizes of quasi-succinct lists in bits, as SQL expressions over Spark's built-in functions (strings for F.expr).

A list of n increments with upper bound u has l lower bits for each, an upper part in unary, and a pointer every 2^q
zeros (docids) or ones (the rest). Integer logarithms go over bin(), never over floating point.
"""

from __future__ import annotations


def lower_bits(n: str, u: str, strict: bool) -> str:
    spare = f"(({u}) - ({n}))" if strict else f"({u})"
    return f"(case when ({n}) = 0 then 0L else cast(greatest(0, case when {spare} div ({n}) = 0 then 0 else length(bin({spare} div ({n}))) - 1 end) as bigint) end)"


def ceil_log2(x: str) -> str:
    return f"(case when ({x}) <= 2 then greatest(0L, ({x}) - 1) else cast(length(bin(({x}) - 1)) as bigint) end)"


def floor_log2(x: str) -> str:
    return f"cast(length(bin({x})) - 1 as bigint)"


def docid_sizes(df: str, n_docs: str, q: int) -> dict[str, str]:
    """l, pointer_width, n_pointers and bits of a docid list: df + 1 elements (with the end mark) up to n_docs, pointers to zeros."""
    l = lower_bits(f"{df} + 1", n_docs, False)  # noqa: E741
    hi = f"shiftright({n_docs}, cast({l} as int))"
    width = ceil_log2(f"({df} + 1 + {hi})")
    count = f"shiftright({hi}, {q})"
    return {"l": l, "pointer_width": width, "n_pointers": count, "bits": f"({width} * {count} + {l} * ({df} + 1) + {hi} + {df} + 1)"}


def strict_sizes(n: str, u: str, total: str, q: int) -> dict[str, str]:
    """l, pointer_width, n_pointers and bits of a strict list of n elements with bound u whose sum is total, pointers to ones."""
    l = lower_bits(n, u, True)  # noqa: E741
    hi = f"shiftright(({u}) - ({n}), cast({l} as int))"
    width = ceil_log2(f"(({n}) + {hi} + 1)")
    count = f"shiftright({n}, {q})"
    upper = f"shiftright(({total}) - ({n}), cast({l} as int))"
    return {"l": l, "pointer_width": width, "n_pointers": count, "bits": f"(case when ({n}) = 0 then 0L else {width} * {count} + {l} * ({n}) + {upper} + ({n}) end)"}


def position_header(l: str, width: str, count: str) -> str:  # noqa: E741
    """Bits of a position list's header: l in gamma code and, if there are pointers, their width in non-zero gamma code."""
    return f"(2 * {floor_log2(f'({l}) + 1')} + 1 + case when ({count}) > 0 then 2 * {floor_log2(width)} + 1 else 0L end)"
