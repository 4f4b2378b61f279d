"""Plain versions of the folds, for the tests."""


def _groups(parts, size, joiner, end):
    groups = []
    for p in filter(None, (x.strip() for x in parts)):
        if groups and len(joiner.join(groups[-1])) + len(p) <= size:
            groups[-1].append(p)
        else:
            groups.append([p])
    return [joiner.join(g) + end for g in groups]


def plain_chunks(text, size=1000):
    """C2, or C3 where that gives nothing or a chunk of over twice the size."""
    by_paragraph = _groups((text or "").split("\n\n"), size, "\n\n", "")
    if by_paragraph and max(map(len, by_paragraph)) <= 2 * size:
        return by_paragraph
    return _groups((text or "").replace("\n", " ").split(". "), size, " ", ".")
