"""Plain definitions that the operators are held against on small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def without_repeats(rows, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, digest of what is kept)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    threes = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if threes[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, distance=3):
    """id -> smallest id reachable over pairs within the distance."""
    label = {i: i for i in fingerprints}
    ids = sorted(fingerprints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            near = [b for b in ids if bin(fingerprints[a] ^ fingerprints[b]).count("1") <= distance]
            low = min(label[b] for b in near)
            if low < label[a]:
                label[a], changed = low, True
    return label


def spans(text):
    """Plain identifiers by the patterns as given."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def highest_quotients(weights, seats):
    """Seats one after another to the highest weight / (2 a + 1); ties to the smaller key."""
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got
