"""Small tables with awkward rows, and plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns whose names clash with those that the operators use inside.
EXTRA = "spans string, items string, fp string, blob string, tag string, start string, kind string, component_id string, n_words string, kept string, rank string, length string"
N_EXTRA = EXTRA.count(",") + 1
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ly", str(rng.randrange(50))]) for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in out)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(40, base[3]), (41, base[3]), (42, base[4] + " tail"), (43, "x " + base[5]), (44, base[6][: len(base[6]) // 2] + " changed " + base[6][len(base[6]) // 2 :])]
    rows += [(50, None), (51, ""), (52, "   \n\t "), (None, base[7]), (None, None), (53, "a"), (54, "été ß 漢字 \U0001f600 " * 30), (55, "a" * 700), (56, "ab" * 400), (57, "\n".join(["same line here"] * 9))]
    rows += [(7, base[7]), (7, base[7]), (60, prose(rng, 30_000)), (61, "line one\r\nline one\rx" + chr(0) + "y"), (62, base[0] + "\n" + base[1] + "\n" + base[0])]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None, *["clash"] * N_EXTRA) for i, t in rows], DOCS).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows_of(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def removed_windows(rows: list[tuple[int | None, str | None]], size: int = 50) -> list[tuple]:
    """What op1 returns, from a table of all windows."""
    order = lambda i: float("inf") if i is None else i
    first: dict[bytes, float] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in data:
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, raw in data:
        gone = [False] * len(raw)
        for p in range(len(raw) - size + 1):
            if first[raw[p : p + size]] < order(i):
                gone[p : p + size] = [True] * size
        n_spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), n_spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def base_rules(text: str | None) -> tuple:
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def longest_repeats(raw: bytes, least: int) -> tuple[int, int]:
    """Bytes covered by repeated substrings of `least` bytes, and the longest repeat."""
    places = defaultdict(list)
    for p in range(len(raw) - least + 1):
        places[raw[p : p + least]].append(p)
    gone, longest = set(), 0
    for own in places.values():
        if len(own) > 1:
            for p in own:
                gone.update(range(p, p + least))
            for a in own:
                for b in own:
                    if a < b:
                        n = least
                        while b + n < len(raw) and raw[a + n] == raw[b + n]:
                            n += 1
                        longest = max(longest, n)
    return len(gone), longest


def simhash(text: str | None) -> int:
    import xxhash

    w = words(lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(ones))


def components(fingerprints: list[int], most: int = 3) -> dict[int, int]:
    """A root for each fingerprint, by comparing all pairs."""
    root = {f: f for f in fingerprints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(root)
    for k, a in enumerate(own):
        for b in own[:k]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}
