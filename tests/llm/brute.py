"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict


def components(keys, linked):
    """key -> smallest key reachable; ``linked``: pairs."""
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def simhash(text, k=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def simhash_rows(rows, bits=2):
    """rows: (id, text) -> {(id, fingerprint, component)}, ids distinct."""
    fps = {i: simhash(t) for i, t in rows}
    ids = sorted(fps)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= bits]
    comp = components(ids, linked)
    return {(i, f"{fps[i]:016x}", comp[i]) for i in ids}


def token_rows(rows, path, end):
    """(id, text) by rising id -> [(id, start, n, crc)]."""
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def piece_rows(rows, path, end=0, capacity=2048):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(path), set()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        for p, (a, b) in enumerate(zip([0, *cuts], cuts)):
            out.add((i, p, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
    return out


def repeated_windows(rows, k=20):
    """rows: (id, text) -> [(id, n_words, n_removed, sha256)]."""
    seen, out = set(), []
    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for a in range(len(words) - k + 1):
            w = tuple(words[a:a + k])
            if w in seen:
                gone.update(range(a, a + k))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _test_words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination(rows, items, k=10):
    """rows (id, text), items (id, text) -> [(id, n_words, n_hit, n_items, sha256, contaminated)]."""
    windows = defaultdict(set)
    for i, t in items:
        w = _test_words(t)
        for a in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[a:a + k])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in rows:
        w, hit, found = _test_words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[a:a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= got
        text = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return out


def personal(text):
    """Base spans of a text: [(kind, start, end)], by start and kind."""
    t, out = text or "", []

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if n % 2 else int(c) for n, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))
