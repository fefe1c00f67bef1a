"""Plain-Python readings of the contracts, to hold the operators against."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, width=13):
    first = {}
    split = [(i, words(t)) for i, t in docs]
    big = float("inf")
    for i, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] < (big if i is None else i):
                gone.update(range(s, s + width))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_base(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = words(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        places = {}
        for s in range(len(w) - 4):
            places.setdefault(tuple(w[s:s + 5]), []).append(s)
        cover = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(5)}
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(cover),
                    len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=4):
    w = words(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard_components(docs, size=4, percent=85):
    """(doc_id, set size, smallest reachable id); documents are compared through an inverted index."""
    from collections import Counter, defaultdict
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for g in s for j in index[g]).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
        for g in s:
            index[g].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if r not in least else min(least[r], d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]


def encoded(docs, end):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, e.ids + [end]) for (i, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False))]


def crc(ids):
    import zlib
    import numpy as np
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def record_rows(docs):
    out, start = [], 0
    for i, ids in encoded(sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or "")), 1):
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def piece_rows(docs, capacity=2048):
    return [(i, p, p * capacity, len(ids[p * capacity:(p + 1) * capacity]), crc(ids[p * capacity:(p + 1) * capacity]))
            for i, ids in encoded(docs, 0) for p in range(-(-len(ids) // capacity))]


def packing_faults(rows, capacity=2048):
    """rows: (sequence_id, offset, length). What is wrong with the layout."""
    from collections import defaultdict
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    bad = []
    for s, parts in by.items():
        at = 0
        for o, n in sorted(parts):
            if o != at:
                bad.append((s, "gap"))
            at += n
        if at > capacity:
            bad.append((s, "full"))
    return bad, len(by)


def base_scores(docs):
    import math
    import zlib
    from collections import Counter
    count, n = Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            tokens = words(lower(t)) + [None]
            count.update(tokens)
            n += len(tokens)
    out = []
    for i, t in docs:
        tokens = words(lower(t)) + [None]
        out.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(count[w] > 0 for w in tokens), n,
                    sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in tokens)))
    return out


def exact_rows(docs):
    """(doc_id, keep_id, group_size, digest) and the number of different texts."""
    from collections import defaultdict
    groups = defaultdict(list)
    for i, t in docs:
        groups[lower(t)].append(i)
    return [(i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]),
             hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in docs], len(groups)


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, ngrams):
    """The number of words and all runs of 1 to ``ngrams`` of them."""
    w = LETTERS.findall(lower(text))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]


def importance(docs, target, ngrams=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score) of every row, and (-score, null id, id) of the drawn ones in order."""
    import math
    import zlib
    from collections import Counter
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(t, ngrams)) for i, t in docs]
    source = Counter(bucket(f) for _, _, x in found for f in x)
    aim = Counter(bucket(f) for t in target for f in runs(t, ngrams)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = lambda k: math.floor(1000 * math.log((aim[k] + 1) * (s + buckets) / ((source[k] + 1) * (t + buckets))))
    rows, able = [], []
    for i, words_, x in found:
        weight = sum(gain(bucket(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(x), weight, score))
        if words_ >= least:
            able.append((-score, i is None, i or 0))
    return rows, sorted(able)[:len(able) * percent // 100]


def vector_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error, label_error, digest) from (vec_id, label, vector) in Python integers."""
    import math
    from collections import Counter, defaultdict
    fit = [(i, l, [math.floor(4096 * x) for x in v]) for i, l, v in rows
           if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fit = [r for r in fit if len(r[2]) == len(fit[0][2])]
    width = len(fit[0][2]) // parts if fit else 0
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in fit]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(book) for book in books]
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[near(p, v[p])[1]].append(v[p])
            for e, members in groups.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    most, out, total = 2**63 - 1, [], Counter()
    for (i, label, _), v in zip(fit, cut):
        best = [near(p, x) for p, x in enumerate(v)]
        error = min(sum(d for d, _ in best), most)
        total[label] += error
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), error))
    return [(*r, min(total[r[1]], most), digest) for r in out]
