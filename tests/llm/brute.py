"""Plain-Python models of the operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n=120, vocabulary=400):
    """Documents with exact copies, near copies, shared passages, repeated lines, nulls and empties."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choices(words, k=60))
    line = "This line is Common to many documents"
    texts = []
    for i in range(n):
        r = rng.random()
        if texts and r < 0.1:
            texts.append(rng.choice(texts))
        elif texts and r < 0.35 and (base := rng.choice([t for t in texts if t] or ["x"])):
            w = base.split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            t = " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 150, 300])))
            if rng.random() < 0.4:
                t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
            if rng.random() < 0.4:
                t += "\n  " + rng.choice([line, line.lower() + "\t", line.upper()]) + "\nshort\n" + line
            texts.append(t)
    texts[3], texts[7] = None, ""
    texts[11] = "ab" * 400
    texts[12] = "ab" * 300
    return [(i * 3 + 1, t, "en" if i % 3 else None, f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def windows_removed(sequences, width, own_too):
    """sequences: (doc_id, sequence); the places covered by windows seen in a smaller document (or, own_too, earlier in the same)."""
    seen, out = set(), {}
    for doc, seq in sorted(sequences, key=lambda x: x[0]):
        gone, new = set(), set()
        for i in range(len(seq) - width + 1):
            w = tuple(seq[i : i + width])
            if w in seen or (own_too and w in new):
                gone.update(range(i, i + width))
            new.add(w)
        seen |= new
        out[doc] = gone
    return out


def spans(places):
    return sum(1 for p in places if p - 1 not in places)


def op1(rows, width=50):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    gone = windows_removed(data, width, False)
    return {d: (len(b), len(gone[d]), spans(gone[d]), sha(bytes(x for i, x in enumerate(b) if i not in gone[d]))) for d, b in data}


def op6(rows, width=20):
    data = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    gone = windows_removed(data, width, True)
    return {d: (len(w), len(gone[d]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[d]))) for d, w in data}


def op4(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        for x in (r[1] or "").split("\n"):
            first.setdefault(key(x), r[0])
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == r[0]]
        out[r[0]] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def op10(rows, percent=75):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def op7_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = {}
    for t in tri:
        counts[t] = counts.get(t, 0) + 1
    covered = {j for i, t in enumerate(tri) if counts[t] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n
