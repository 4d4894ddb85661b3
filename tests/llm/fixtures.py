"""Small tables with every awkward case, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

AWKWARD = [
    None, "", " ", "\n\n", "one", "one two three four", "one two three four", "é è ñ", "中文 字", "!!! ***",
    "a b c d e f g h i j k l m n o p", "A B C D E F G H I J K L M N O P", "x" * 3000, "word " * 3000,
    "line one is here\nline one is here\n\nother", "tab\tand\x0bform\x0cfeed\rreturn", "<|endoftext|> stays text",
    "  leading and trailing  ", "a b c　d", "it's DON'T we'll", "1 22 333 a1b2",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, spans string"


def prose(seed: int, words: int, size: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}{'abcdef'[rng.randrange(6)]}" for _ in range(words)]


def texts() -> list[str | None]:
    """Prose, copies, near copies, shared passages and the awkward cases."""
    base = [prose(k, 120) for k in range(12)]
    found = [" ".join(b) for b in base]
    for k in range(6):
        near = list(base[k])
        near[30 + k] = "changed"
        near[90] = "again"
        found += [" ".join(near), " ".join(base[k]), " ".join(base[k][:60] + prose(100 + k, 60))]
    passage = prose(999, 60)
    found += [" ".join(prose(200 + k, 50) + passage + prose(300 + k, 50)) for k in range(5)]
    return found + AWKWARD


def documents(spark):
    rows = [(k + 1, t, "en" if k % 2 else None, "s", 1, 9, True, "x") for k, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, "no id here at all, only text", None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alphanumeric_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def shingle_set(text: str | None) -> frozenset:
    w = plain_words(lower(text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def near_groups(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """n_shingles and component of every document, all pairs compared."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = alphanumeric_words(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k:k + m]), set()).add(item)
    sizes = {len(x) for x in windows}
    found = []
    for doc_id, text in docs:
        w, hit, seen = alphanumeric_words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    seen |= windows[tuple(w[k:k + m])]
        named = sorted(str(x) for x in seen if x is not None)
        found.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return found


def base_quality(text: str | None) -> tuple:
    w = plain_words(text)
    lines = [x for x in (text or "").split("\n") if plain_words(x)]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    marked = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), failed,
    )


def luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def personal_data(text: str | None) -> tuple:
    def digits(m: str) -> str:
        return re.sub("[^0-9]", "", m)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    counts, spans = [], []
    for kind, pattern, holds in kinds:
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if holds(m.group())]
        counts.append(len(own))
        spans += own
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())
