"""Plain versions of the operators, and small tables with the hard cases."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, host string, kept string, n_words string, carried string, node string, row string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(UPPER)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def prose(rng, n):
    parts = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vé", "wü", "xi"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def table(seed=5, n=60):
    """Rows of SCHEMA: prose, copies, near copies, shared lines and passages, nulls, blanks, long texts, repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(prose(rng, 60))
    line = "A line that many Documents share, " + " ".join(prose(rng, 6))
    base = prose(rng, 90)
    texts = []
    for i in range(n):
        own = " ".join(prose(rng, rng.randint(1, 150)))
        kind = i % 10
        if kind == 0:
            own = own + " " + passage + "\t" + " ".join(prose(rng, 12))
        elif kind in (1, 2):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "".join(prose(rng, 2))
            own = " ".join(copy)
        elif kind == 3:
            own = own + "\n  " + (line.upper() if i % 20 == 3 else line) + " \r\n" + " ".join(prose(rng, 9)) + "\n"
        elif kind == 4 and texts:
            own = texts[rng.randrange(len(texts))]
        texts.append(own)
    texts += [None, "", " \n\t ", "one", "two words", "\n\n", "ab " * 60, "x" * 120_000, " ".join(prose(rng, 9000)), " ".join(base), "a\x0bb\x0cc d e", passage]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows.append(rows[2])
    rows.append((None, passage, None, None, None))
    rows.append((3, " ".join(base), "en", "s1", 5))
    return [(*r, 1, "h", "k", "w", "c", "n", "r") for r in rows]


def line_dedup(rows):
    ids = lambda r: -1 if r[0] is None else r[0]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(ids(r))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and ids(r) < max(holders[key(x)]))]
        out.append((r[0], len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def substrings(rows, k):
    ids = lambda r: -1 if r[0] is None else r[0]
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - k + 1):
            v = tuple(w[i : i + k])
            first[v] = min(first.get(v, ids(r)), ids(r))
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < ids(r):
                gone.update(range(i, i + k))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def byte_repeats(rows, k=100):
    """Rows of one id follow one another in the order of their texts, null and smaller first."""
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    seen, out = set(), []
    for r in order:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - k + 1):
            v = data[i : i + k]
            if v in seen:
                gone[i : i + k] = b"\1" * k
            seen.add(v)
        flags = bytes(gone)
        spans = len(re.findall(b"\1+", flags))
        out.append((r[0], len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, k, percent=80):
    """(doc_id, set size, component id) of every row."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i), r[0]) if sets[i] else r[0]) for i, r in enumerate(rows)]


def rule_counts(text):
    text = text or ""
    w = words(text)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again)


def base_failed(c):
    return c[0] < 10 or 100 * c[5] > 20 * c[0]


def failed(c):
    return base_failed(c) or 100 * c[2] > 10 * c[1] or 100 * c[4] > 30 * c[3]


def bad_hosts(rows):
    hosts = {}
    for r in rows:
        if r[3] is not None:
            hosts.setdefault(r[3], []).append(failed(rule_counts(r[1])))
    if not hosts:
        return set()
    n = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / n
    spread = sum(sum(f) * sum(f) / len(f) for f in hosts.values()) / n - mean * mean
    weight = max(1.0, min(1e6, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    return {h for h, f in hosts.items() if (sum(f) + mean * weight) / (len(f) + weight) >= 0.5}
