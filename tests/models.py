"""Literal Python models of the loops the operators replace (written from
the stated semantics, used as brute-force references on small inputs)."""

from __future__ import annotations


def select_demos_literal(data, k, strategy):
    """data: list of (input, label, category) in position order."""
    out = []
    for sample in data:
        demos = []
        while len(demos) < k:
            nxt = None
            for demo in reversed(data):
                if demo[0] == sample[0] or demo in demos:
                    continue
                if strategy == "random":
                    ok = True
                elif isinstance(sample[2], list):
                    ok = any(c in sample[2] for c in demo[2])
                else:
                    ok = sample[2] == demo[2]
                if ok:
                    nxt = demo
                    break
            if nxt is None:
                break
            demos.append(nxt)
        out.append(demos if len(demos) == k else None)
    return out


def lcs(a, b):
    m, n = len(a), len(b)
    dp = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[m][n]


def f_score(expected_set, predicted_words):
    tp = sum(w in expected_set for w in predicted_words)
    fp = sum(w not in expected_set for w in predicted_words)
    fn = sum(e not in predicted_words for e in expected_set)
    den = tp + 0.5 * (fp + fn)
    return tp / den if den else None


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]
