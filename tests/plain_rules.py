"""The matching rules as plain loops, written from their description, for small inputs."""


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def agree(a, b):
    if a == b:
        return True
    s, l = sorted((a, b), key=len)
    if l.startswith(s) and len(l) - len(s) <= 3:
        return True
    return len(s) >= 5 and edits(a, b) <= (1 if len(s) <= 7 else 2)


def score(first, second, empty):
    if not first and not second:
        return 1.0
    if not first or not second:
        return 1.0 if empty else 0.0
    free, matched = list(second), 0
    for t in first:
        hit = next((o for o in free if agree(t, o)), None)
        if hit is not None:
            matched += 1
            free.remove(hit)
    return matched / (len(first) + len(second) - matched)


def assign(items, stored=(), threshold=0.70):
    """items: (block, key, tokens) in order; stored: the same for existing masters. Key -> master key."""
    leaders, out = {}, {}
    for block, key, tokens in stored:
        leaders.setdefault(block, []).append((key, tokens))
    for block, key, tokens in items:
        best_score, best = 0.0, None
        for leader, words in leaders.setdefault(block, []):
            s = score(words, tokens, True)
            if s > best_score:
                best_score, best = s, leader
        if best is not None and best_score >= threshold:
            out[key] = best
        else:
            leaders[block].append((key, tokens))
            out[key] = key
    return out
