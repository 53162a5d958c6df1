"""Near-duplicate groups by comparing every pair."""


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_pairs(texts):
    sets, out = [shingles(t) for t in texts], set()
    for a, x in enumerate(sets):
        for b in range(a):
            o, y = len(x & sets[b]), sets[b]
            if 5 * o >= 4 * (len(x) + len(y) - o):
                out.add((b, a))
    return out


def brute_least(texts):
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for b, a in sorted(brute_pairs(texts)):
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(a) for a in range(len(texts))]
