import re


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, k, percent):
    """Component of each document id, comparing all pairs of full sets."""
    sets = [(i, word_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def repeated_runs(docs, n):
    """Words of each document in runs of n words that occur at an earlier place, counted by document."""
    first, out = set(), {}
    for doc_id in sorted(docs):
        words = [w.lower() for w in docs[doc_id]]
        hit = set()
        for i in range(len(words) - n + 1):
            run = tuple(words[i : i + n])
            if run in first:
                hit |= set(range(i, i + n))
            first.add(run)
        if hit:
            out[doc_id] = len(hit)
    return out
