"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WHITE = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def secrets(text):
    text, spans = text or "", []
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(key + "[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    spans.sort()
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), sha(listed)), listed


def lines(docs, min_docs):
    """docs: {id: text}."""
    key = lambda x: ascii_lower(x).strip(WHITE)
    count = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for d, t in docs.items():
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or count[key(x)] < min_docs]
        out[d] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)))
    return out


def contamination(docs, items, window=10):
    """items: list of (id, text)."""
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or "")) if w]
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        if n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        w, hit, who = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[g]
        out[d] = (len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit))
    return out


def base_rules(text):
    w, t = words(text), text or ""
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    rows = [x for x in t.split("\n") if x.strip(WHITE)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def fingerprint(text):
    w = ascii_lower(text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most):
    """prints: {id: fingerprint}; id to the smallest id that links of at most `most` bits reach."""
    group = {d: d for d in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in ids}


def bytes_dedup(docs, n):
    """Every byte covered by an n-byte string that starts at two places goes."""
    seen = Counter()
    data = {d: (t or "").encode() for d, t in docs.items()}
    for b in data.values():
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        out[d] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def words_dedup(docs, n):
    """Every word covered by an n-word window that starts earlier elsewhere goes. docs: {id: text}."""
    first, out = set(), {}
    for d in sorted(docs):
        w = words(docs[d])
        gone = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in first:
                gone |= set(range(i, i + n))
            first.add(g)
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def crc32_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def similar_groups(docs, n, limit):
    """{id: smallest id reachable} by pairs of texts whose sets of n-word shingles have a Jaccard similarity of limit or more."""
    sets = {}
    for d, t in docs.items():
        w = words(ascii_lower(t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()
    root = {d: d for d in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= limit * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in docs}
