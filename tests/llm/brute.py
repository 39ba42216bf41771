"""Plain Python forms of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import re

SPACE = r"[\x20\x09-\x0D]"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m.group())) <= 15),
}
SECRET = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def spans(text: str | None, kinds: dict) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, kind) of the base matches."""
    out = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
    return sorted(out)


def joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text: str | None, n: int = 3) -> int:
    from xxhash import xxh64
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(fps: dict[int, int], bits: int = 2) -> dict[int, int]:
    """Smallest reachable id of every id, by comparing all pairs."""
    import numpy as np
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def mix_targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Target of every source, resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        for s in full or open_:
            target[s] = float(most * sizes[s]) if full else weight[s] * share
        left -= sum(target[s] for s in full) if full else left
        open_ -= full or open_
    return target
