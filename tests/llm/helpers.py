"""Small documents with every awkward case, and brute-force versions that the operators are held against."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, runs string, score string"


def documents(seed=1):
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages, repeats and clashing columns."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ab", "en", "il", "orn", "úma")]
    make = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    passage, base = make(40), make(120)
    texts = [" ".join(make(rng.randint(1, 150))) for _ in range(12)]
    texts += [" ".join(base)] * 3
    for k in range(8):
        near = list(base)
        near[k * 13 % 120] = f"edit{k}"
        texts.append("  ".join(near) if k % 2 else "\n".join(near).upper())
    texts += [" ".join(make(15) + passage + make(9)) for _ in range(6)]
    texts += [" ".join(passage[:20]), " ".join(passage[:19]), "one two", "one  two", "ONE TWO", "", None, None, " \t\n", "... 123 !!!"]
    texts += [" ".join(["na"] * 70), " ".join(make(5000)), "x" * 30000]
    return [(i, t, "en", "s", 0, "h", "r", "sc") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text, width):
    w = spaced(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(rows, width, per_cent):
    """doc_id -> (size, component), by comparing all pairs."""
    sets = {r[0]: shingles(r[1], width) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def kept_words(rows, window=20):
    """doc_id -> (words, removed, kept), by a dictionary of all windows in order."""
    seen, out = set(), {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        w = spaced(text)
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        out[doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def benchmark_hits(rows, items, n=10):
    """doc_id -> (words, hit words, items)."""
    windows = [(item, tuple(w[i : i + min(n, len(w))])) for item, t in items for w in [alnum(t)] if w for i in range(max(1, len(w) - n + 1))]
    out = {}
    for doc_id, text in ((r[0], r[1]) for r in rows):
        w = alnum(text)
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out
