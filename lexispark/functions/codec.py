"""The list codec in numpy, and its Arrow functions: monotone lists as bit strings, least significant bit first.

A list's parts follow each other without alignment: pointers, lower bits, upper bits (unary gaps). Parameters that a reader can
derive (lower bits, pointer width and count) aren't stored, but for position lists, which carry their lower bits in a header.
"""

from __future__ import annotations

import numpy as np


BLOCK = 1 << 12  # values from which on bits are taken one by one of all values, in little memory


def lower_bits(n: int, u: int, strict: bool) -> int:
    spare = u - n if strict else u
    return max(0, (spare // n).bit_length() - 1) if n else 0


def ceil_log2(x: int) -> int:
    return max(0, x - 1) if x <= 2 else (x - 1).bit_length()


def pointer_width(n: int, u: int, l: int, strict: bool, zeros: bool) -> int:  # noqa: E741
    return max(0, ceil_log2(n + ((u - n if strict else u) >> l) + (0 if zeros else 1)))


def pointer_count(n: int, u: int, l: int, q: int, strict: bool, zeros: bool) -> int:  # noqa: E741
    if n == 0:
        return 0
    return ((u - n if strict else u) >> l) >> q if zeros else n >> q


def fixed(values: np.ndarray, width: int) -> np.ndarray:
    """Bits of the values, ``width`` each."""
    x = np.asarray(values, np.int64)
    if len(x) <= BLOCK:
        return ((x[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    out = np.empty((len(x), width), np.uint8)
    for j in range(width):
        out[:, j] = (x >> j) & 1
    return out.ravel()


def gamma(x: int) -> np.ndarray:
    """x + 1 in Elias gamma code: its bit length less one in unary, then the bits below its highest."""
    m = (x + 1).bit_length() - 1
    return np.concatenate([np.zeros(m, np.uint8), np.ones(1, np.uint8), fixed(np.array([x + 1 - (1 << m)]), m)])


def read_gamma(bits: np.ndarray, at: int) -> tuple[int, int]:
    """The number at a place and the place behind it."""
    m = int(np.flatnonzero(bits[at:])[0])
    rest = bits[at + m + 1 : at + 2 * m + 1].astype(np.int64)
    return int((rest << np.arange(m)).sum()) + (1 << m) - 1, at + 2 * m + 1


def encode(values: np.ndarray, u: int, q: int, strict: bool, zeros: bool) -> np.ndarray:
    """Bits of a list of increments with upper bound u; lists with pointers to zeros get u itself as an end mark."""
    x = np.asarray(values, np.int64)
    if strict and len(x) and x.min() < 1:
        raise ValueError("a strict list needs increments of at least 1")
    if x.sum() > u:
        raise ValueError("the increments exceed the bound")
    sums = np.cumsum(x - strict)
    if zeros:
        sums = np.append(sums, u)
    n = len(sums)
    l = lower_bits(n, u, strict)  # noqa: E741
    high = sums >> l
    upper = np.zeros(int(high[-1]) + n if n else 0, np.uint8)
    upper[high + np.arange(n)] = 1
    width, count = pointer_width(n, u, l, strict, zeros), pointer_count(n, u, l, q, strict, zeros)
    kth = np.arange((1 << q) - 1, count << q, 1 << q)  # the last of every 2^q zeros or ones
    if zeros:  # before a zero stand the ones whose high bits are no more than its number
        marks = kth[kth < len(upper) - n] if n else kth[:0]
        marks = marks + np.searchsorted(high, marks, "right") + 1
    else:
        marks = high[kth] + kth + 1
    pointers = np.zeros(count, np.int64)
    pointers[: len(marks)] = marks
    return np.concatenate([fixed(pointers, width), fixed(sums & ((1 << l) - 1), l), upper])


def decode(bits: np.ndarray, n: int, u: int, q: int, strict: bool, zeros: bool, l: int | None = None) -> np.ndarray:  # noqa: E741
    """Prefix sums of the n increments (strict lists: of the increments themselves)."""
    m = n + zeros
    if m == 0:
        return np.zeros(0, np.int64)
    l = lower_bits(m, u, strict) if l is None else l  # noqa: E741
    at = pointer_width(m, u, l, strict, zeros) * pointer_count(m, u, l, q, strict, zeros)
    parts = bits[at : at + m * l].reshape(m, l)
    if m <= BLOCK:
        low = (parts.astype(np.int64) << np.arange(l)).sum(axis=1)
    else:
        low = np.zeros(m, np.int64)
        for j in range(l):
            low |= parts[:, j].astype(np.int64) << j
    high = np.flatnonzero(bits[at + m * l :])[:m] - np.arange(m)
    sums = (high << l) | low
    return (sums + strict * np.arange(1, m + 1))[:n]


FEW = 24  # elements up to which a list is coded as one whole number, without arrays; most terms have such lists


def _int_gamma(x: int) -> tuple[int, int]:
    m = (x + 1).bit_length() - 1
    return 1 << m | (x + 1 - (1 << m)) << (m + 1), 2 * m + 1


def encode_few(values: list[int], u: int, q: int, strict: bool, zeros: bool) -> tuple[int, int]:
    """As :func:`encode`, of a short list: the bits as a number, and how many they are."""
    if strict and values and min(values) < 1:
        raise ValueError("a strict list needs increments of at least 1")
    if sum(values) > u:
        raise ValueError("the increments exceed the bound")
    sums, s = [], 0
    for v in values:
        s += v - strict
        sums.append(s)
    if zeros:
        sums.append(u)
    n = len(sums)
    if not n:
        return 0, 0
    l = lower_bits(n, u, strict)  # noqa: E741
    width, count = pointer_width(n, u, l, strict, zeros), pointer_count(n, u, l, q, strict, zeros)
    mask, low, upper = (1 << l) - 1, 0, 0
    high = [x >> l for x in sums]
    for i, x in enumerate(sums):
        low |= (x & mask) << i * l
        upper |= 1 << high[i] + i
    pointers = 0
    for j in range(count):
        k = (j + 1 << q) - 1
        if not zeros:
            mark = high[k] + k + 1
        elif k < high[-1]:
            mark = k + sum(h <= k for h in high) + 1
        else:
            break
        pointers |= mark << j * width
    at = width * count
    return pointers | low << at | upper << at + n * l, at + n * l + high[-1] + n


def decode_few(bits: int, n: int, u: int, q: int, strict: bool, zeros: bool, l: int | None = None) -> list[int]:  # noqa: E741
    """As :func:`decode`, of a short list as a number."""
    m = n + zeros
    l = lower_bits(m, u, strict) if l is None else l  # noqa: E741
    low = bits >> pointer_width(m, u, l, strict, zeros) * pointer_count(m, u, l, q, strict, zeros)
    upper, mask, out, at = low >> m * l, (1 << l) - 1, [], -1
    for i in range(n):
        step = (upper & -upper).bit_length()
        at += step
        upper >>= step
        out.append((at - i << l | low >> i * l & mask) + (i + 1 if strict else 0))
    return out


def _bytes(bits: int, n: int) -> tuple[bytes, int]:
    return bits.to_bytes((n + 7) // 8, "little"), n


def packed_docids(docids: np.ndarray, n_docs: int, q: int) -> tuple[bytes, int]:
    """Packed bits of the list, and how many they are."""
    if len(docids) <= FEW:
        d = docids.tolist()
        return _bytes(*encode_few([b - a for a, b in zip([0, *d], d, strict=False)], n_docs, q, False, True))
    bits = encode_docids(docids, n_docs, q)
    return pack(bits), len(bits)


def packed_freqs(tfs: np.ndarray, cf: int, q: int) -> tuple[bytes, int]:
    if len(tfs) <= FEW:
        return _bytes(*encode_few(tfs.tolist(), cf, q, True, False))
    bits = encode_freqs(tfs, cf, q)
    return pack(bits), len(bits)


def packed_positions(flat: np.ndarray, tfs: np.ndarray, q: int) -> tuple[bytes, int]:
    if len(flat) > FEW or not len(flat):
        bits = encode_flat_positions(flat, tfs, q)
        return pack(bits), len(bits)
    x, at, u = flat.tolist(), 0, len(tfs)
    gaps = [b - a for a, b in zip([0, *x], x, strict=False)]
    for f in tfs.tolist():
        gaps[at] = x[at] + 1
        at += f
        u += x[at - 1]
    n = len(x)
    l = lower_bits(n, u, True)  # noqa: E741
    head, size = _int_gamma(l)
    if n >> q:
        more, k = _int_gamma(pointer_width(n, u, l, True, False) - 1)
        head, size = head | more << size, size + k
    bits, k = encode_few(gaps, u, q, True, False)
    return _bytes(head | bits << size, size + k)


def read_docids(data: bytes, df: int, n_docs: int, q: int) -> np.ndarray | list[int]:
    """Docids of packed bits; of short lists as a list."""
    return decode_few(int.from_bytes(data, "little"), df, n_docs, q, False, True) if df <= FEW else decode_docids(unpack(data), df, n_docs, q)


def read_freqs(data: bytes, df: int, cf: int, q: int) -> np.ndarray | list[int]:
    if df > FEW:
        return decode_freqs(unpack(data), df, cf, q)
    sums = decode_few(int.from_bytes(data, "little"), df, cf, q, True, False)
    return [b - a for a, b in zip([0, *sums], sums, strict=False)]


def read_positions(data: bytes, tfs: np.ndarray | list[int], cf: int, u: int, q: int) -> np.ndarray | list[int]:
    """Positions of all postings of a term, one list after the other; cf of them."""
    if cf > FEW or not cf:
        return decode_flat_positions(unpack(data), np.asarray(tfs, np.int64), u, q)
    bits, at = int.from_bytes(data, "little"), 0

    def number() -> int:
        nonlocal at
        x = bits >> at
        m = (x & -x).bit_length() - 1
        at += 2 * m + 1
        return (x >> m + 1 & (1 << m) - 1) + (1 << m) - 1

    l = number()  # noqa: E741
    if cf >> q:
        number()
    sums, out, i, before = decode_few(bits >> at, cf, u, q, True, False, l), [], 0, 0
    for f in tfs:
        out += [s - before - 1 for s in sums[i : i + f]]
        i += f
        before = sums[i - 1]
    return out


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


def encode_docids(docids: np.ndarray, n_docs: int, q: int) -> np.ndarray:
    return encode(np.diff(docids, prepend=0), n_docs, q, False, True)


def decode_docids(bits: np.ndarray, df: int, n_docs: int, q: int) -> np.ndarray:
    return decode(bits, df, n_docs, q, False, True)


def encode_freqs(tfs: np.ndarray, cf: int, q: int) -> np.ndarray:
    return encode(tfs, cf, q, True, False)


def decode_freqs(bits: np.ndarray, df: int, cf: int, q: int) -> np.ndarray:
    return np.diff(decode(bits, df, cf, q, True, False), prepend=0)


def encode_positions(lists: list[np.ndarray], q: int) -> np.ndarray:
    """Positions of all postings of a term: increments inside a posting, the first one plus one; with a header."""
    return encode_flat_positions(np.concatenate(lists), np.array([len(p) for p in lists]), q)


def encode_flat_positions(flat: np.ndarray, tfs: np.ndarray, q: int) -> np.ndarray:
    """As :func:`encode_positions`, of positions one list after the other and the lists' lengths (at least 1 each)."""
    flat = np.asarray(flat).astype(np.int64)
    first = np.cumsum(tfs) - tfs
    x = np.diff(flat, prepend=0)
    x[first] = flat[first] + 1
    u = len(tfs) + int(flat[first + tfs - 1].sum())
    n = len(x)
    l = lower_bits(n, u, True)  # noqa: E741
    head = [gamma(l)]
    if n >> q:
        head.append(gamma(pointer_width(n, u, l, True, False) - 1))
    return np.concatenate([*head, encode(x, u, q, True, False)])


def decode_flat_positions(bits: np.ndarray, tfs: np.ndarray, u: int, q: int) -> np.ndarray:
    """Positions of all postings of a term, one list after the other."""
    l, at = read_gamma(bits, 0)  # noqa: E741
    n = int(tfs.sum())
    if n >> q:
        _, at = read_gamma(bits, at)
    sums = decode(bits[at:], n, u, q, True, False, l)
    before = np.concatenate([[0], sums])[np.cumsum(tfs) - tfs]
    return sums - np.repeat(before, tfs) - 1


def decode_positions(bits: np.ndarray, tfs: np.ndarray, u: int, q: int) -> list[np.ndarray]:
    return np.split(decode_flat_positions(bits, tfs, u, q), np.cumsum(tfs)[:-1])


def read_fixed(data: bytes, at: int, width: int) -> int:
    """The number of ``width`` bits at a place in packed bits."""
    return int.from_bytes(data[at >> 3 : (at + width + 7) >> 3], "little") >> (at & 7) & ((1 << width) - 1)


def read_unary(data: bytes, at: int) -> tuple[int, int]:
    """The number of zeros before the next one, and the place behind it."""
    for offset, position in ones_from(data, at):
        return position, at + offset + 1
    raise ValueError("there is no one left")


def ones_from(data: bytes, at: int, chunk: int = 64):
    """Pairs (offset from ``at``, zeros between ``at`` and it) of all ones from a place in packed bits on, read in chunks of bytes."""
    begin, seen = at >> 3, 0
    skip = at & 7
    for a in range(begin, len(data), chunk):
        bits = np.unpackbits(np.frombuffer(data[a : a + chunk], np.uint8), bitorder="little")
        if a == begin:
            bits[:skip] = 0
        for offset in (np.flatnonzero(bits) + (a - begin) * 8 - skip).tolist():
            yield offset, offset - seen
            seen += 1


def next_geq(data: bytes, df: int, n_docs: int, q: int, target: int) -> int | None:
    """The first docid at or above the target in a packed list, None past the end. A pointer leads to the target's zeros; reading goes on from there."""
    if df == 0 or target >= n_docs:
        return None
    target = max(target, 0)
    m = df + 1
    l = lower_bits(m, n_docs, False)  # noqa: E741
    width, count = pointer_width(m, n_docs, l, False, True), pointer_count(m, n_docs, l, q, False, True)
    low = width * count
    k = min(((target >> l) >> q), count)
    start = read_fixed(data, (k - 1) * width, width) if k else 0
    passed = k << q  # zeros before start
    i = start - passed
    for _, zeros in ones_from(data, low + m * l + start):
        if i >= df:
            return None
        value = ((passed + zeros) << l) | read_fixed(data, low + i * l, l)
        if value >= target:
            return value
        i += 1
    return None


def prefix_sum(data: bytes, n: int, u: int, q: int, i: int, l: int | None = None, at: int = 0) -> int:  # noqa: E741
    """Sum of the first i + 1 increments of a packed strict list that begins at a place; a pointer leads to the nearest one before."""
    if i < 0:
        return 0
    l = lower_bits(n, u, True) if l is None else l  # noqa: E741
    width, count = pointer_width(n, u, l, True, False), pointer_count(n, u, l, q, True, False)
    low = at + width * count
    k = min((i + 1) >> q, count)
    start = read_fixed(data, at + (k - 1) * width, width) if k else 0
    left = i - (k << q)
    if left < 0:  # the pointer stands right behind the one that is sought
        place = start - 1
    else:
        place = start + next(offset for j, (offset, _) in enumerate(ones_from(data, low + n * l + start)) if j == left)
    return (((place - i) << l) | read_fixed(data, low + i * l, l)) + i + 1


def freq_at(data: bytes, df: int, cf: int, q: int, i: int) -> int:
    """The i-th frequency of a packed list."""
    return prefix_sum(data, df, cf, q, i) - prefix_sum(data, df, cf, q, i - 1)


def positions_at(data: bytes, before: int, tf: int, cf: int, u: int, q: int) -> list[int]:
    """Positions of one posting of a packed list of cf positions with bound u; before: frequencies of the list's postings before, summed."""
    bits = np.unpackbits(np.frombuffer(data[:64], np.uint8), bitorder="little")
    l, at = read_gamma(bits, 0)  # noqa: E741
    if cf >> q:
        _, at = read_gamma(bits, at)
    base = prefix_sum(data, cf, u, q, before - 1, l, at)
    return [prefix_sum(data, cf, u, q, before + j, l, at) - base - 1 for j in range(tf)]
