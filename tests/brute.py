"""The five match rules and the result orders in plain Python, for small inputs."""

from __future__ import annotations


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def contains(whole: str, part: str) -> bool:
    rest = iter(whole.encode())
    return all(byte in rest for byte in part.encode())


def pairs(mode: str, texts, terms, k: int) -> set[tuple[str, str, int]]:
    found = set()
    for text in set(texts):
        for term in set(terms):
            d = distance(text, term)
            hit = {
                "find": text == term,
                "starts_with": term.startswith(text) and (not k or d <= k),
                "fuzzy": contains(term, text) and (not k or d <= k),
                "levenshtein": d <= k,
            }[mode]
            if hit and term:
                found.add((text, term, d))
    return found


def tagged(mode: str, selection: str, mentions, terms, k: int, passes=lambda place_id: True):
    """``terms`` are (term, type ordinal, id) in insertion order; rows are (reference, term, ord, id, d)."""
    hits = pairs(mode, [text for _, text in mentions], [t for t, _, _ in terms], k)
    rows = []
    for reference, text in mentions:
        matches = [
            (d, ord_, place_id, term.encode(), seq, term)
            for hit_text, hit_term, d in hits
            if hit_text == text
            for seq, (term, ord_, place_id) in enumerate(terms)
            if term == hit_term and passes(place_id)
        ]
        matches.sort(key=lambda m: m[4] if mode == "find" else m[:5])
        if selection == "first":
            matches = matches[:1]
        rows += [(reference, m[5], m[1], m[2], m[0]) for m in matches]
    return sorted(rows)
