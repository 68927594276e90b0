"""Plain versions of the contracts, a document at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def op3(rows):
    kinds = {
        "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile("[0-9a-f]+"), 0, 32),
    }
    out = []
    for doc_id, text in rows:
        spans = []
        for n, (kind, (pattern, group, least)) in enumerate(kinds.items()):
            spans += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        c = Counter(x[3] for x in spans)
        out.append((doc_id, c["assign"], c["access"], c["hex"], sha(base), base))
    return out


def op4(rows, encode, end=2):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*encode(text or ""), end]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def op5(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        failed = n < 50 or 100 * len(repeated) > 50 * n
        out.append((doc_id, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed))
    return out


def op5_kept(text):
    """The verdict of all rules, base ones included."""
    _, n, chars, symbols, dup, _, failed = op5([(0, text)])[0]
    text = text or ""
    words, lines = WORD.findall(text), [x.strip(SPACE) for x in text.split("\n") if WORD.search(x)]
    if failed:
        return False
    run = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]
    four, five = Counter(run(4)), Counter(run(5))
    covered = {j for i, r in enumerate(run(5)) if five[r] > 1 for j in range(i, i + 5)}
    rejected = [
        symbols / n > 0.1,
        dup > 0.6 * len(lines),
        not 2 <= chars / n <= 12,
        sum(x[0] in "-*\u2022" for x in lines) > 0.9 * len(lines),
        sum(x.endswith(("...", "\u2026")) for x in lines) > 0.3 * len(lines),
        sum(any(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or ord(c) > 127 for c in w) for w in words) < 0.8 * n,
        max(map(len, words)) > 1000,
        "lorem ipsum" in ascii_lower(text),
        max((c * len("".join(r)) for r, c in four.items() if c > 1), default=0) > 0.16 * chars,
        sum(len(words[j]) for j in covered) > 0.3 * chars,
    ]
    return not any(rejected)


def op7(rows, min_docs=10, min_chars=1):
    key = lambda line: ascii_lower(line.strip(SPACE))
    where = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(where[key(x)]) >= min_docs)]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op8(rows, window=50):
    least = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def op9(rows, encoder):
    out = []
    for doc_id, text in rows:
        ids = encoder.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(encoder.decode_bytes(ids))))
    return out


def shingles(text, n=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def op10(rows, share=90):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = sorted((len(s), d, s) for d, s in sets if s)
    for i, (n, d, s) in enumerate(order):
        for m, e, t in order[i + 1 :]:
            if 100 * n < share * m:
                break
            both = len(s & t)
            if 100 * both >= share * (n + m - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(s), root(d)) for d, s in sets]
