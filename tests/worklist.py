"""The closure by a plain worklist, to hold results against."""


def closed(edges, rules, vertices=()):
    """edges: (src, label, dst); rules: (lhs, rhs1 or None, rhs2 or None)."""
    done, work = set(), [*edges, *((v, lhs, v) for lhs, b, _ in rules if b is None for v in vertices)]
    while work:
        e = work.pop()
        if e in done:
            continue
        done.add(e)
        s, label, d = e
        for lhs, b, c in rules:
            if b == label and c is None:
                work.append((s, lhs, d))
            if b == label and c is not None:
                work += [(s, lhs, z) for y, m, z in done if y == d and m == c]
            if c == label:
                work += [(x, lhs, d) for x, m, y in done if y == s and m == b]
    return done
