"""Plain Python versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
KINDS = ("assign", "access", "hex", "random")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def fold(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def quality_counts(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def dedup_lines(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, text) of each (doc_id, text)."""
    key = lambda line: low(line.strip(" \t\n\v\f\r"))
    order = lambda d: (d is None, d)
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(order(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shingles(text: str) -> Counter:
    words = WORD.findall(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def probability_jaccard(a: Counter, b: Counter) -> float:
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in keys if a[i] and b[i])


def near_classes(texts: dict, threshold: float = 0.8) -> dict:
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for k in s:
            holders[k].append(d)
    common = Counter()
    for held in holders.values():
        for i, x in enumerate(held):
            common.update((min(x, y), max(x, y)) for y in held[:i])
    for (x, y), n in common.items():
        if n >= 0.4 * max(len(sets[x]), len(sets[y])) and probability_jaccard(sets[x], sets[y]) >= threshold - 1e-12:
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    wordless = [d for d, s in sets.items() if not s]
    return {d: min(wordless) if d in wordless else find(d) for d in texts}


def word_scores(texts: dict, tokens) -> dict:
    counts = Counter(t for d, text in texts.items() if fold(d, 7) != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {
        d: (len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text)))
        for d, text in texts.items()
    }


def ppm_scores(texts: dict, order: int, escape: float) -> dict:
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    streams = {d: b"\n" * order + " ".join(WORD.findall(low(t))).encode() + b"\n" for d, t in texts.items()}
    for d, s in streams.items():
        if fold(d, 7) != 2:
            for p in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][s[p - k : p]][s[p]] += 1
    out = {}
    for d, s in streams.items():
        total = 0.0
        for p in range(order, len(s)):
            gone: set[int] = set()
            for k in range(order, -1, -1):
                left = {x: n for x, n in counts[k].get(s[p - k : p], {}).items() if x not in gone}
                if not left:
                    continue
                if s[p] in left:
                    total += math.log10((left[s[p]] - escape) / sum(left.values()))
                    break
                total += math.log10(escape * len(left) / sum(left.values()))
                gone |= set(left)
            else:
                total -= math.log10(256 - len(gone))
        out[d] = total
    return out


def edited(texts: dict) -> dict:
    ids = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        out[d] = text[: len(text) - half] + after[:half]
    return out


def quality_verdicts(rows: list[tuple], rules) -> dict:
    """doc_id -> kept, of (doc_id, text, lang): both histograms against references learned twice, in plain Python."""
    import unicodedata

    def classes(text: str) -> list[float]:
        tests = (
            lambda c: unicodedata.category(c) == "Ll", lambda c: unicodedata.category(c) == "Lu", lambda c: unicodedata.category(c) == "Nd",
            lambda c: c in " \t\n\v\f\r", lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>{}[]\\^~_=+@/",
        )
        counts = [float(sum(map(t, text))) for t in tests]
        return [*counts, len(text) - sum(counts)]

    def bins(text: str) -> list[float]:
        words = [w.rstrip(".,;:!?").lower() for w in WORD.findall(text)]
        found = Counter(w for w in words if w in rules.BINS)
        return [float(found[w]) for w in rules.BINS] + [float(len(words) - sum(found.values()))]

    def shares(counts):
        total = sum(counts)
        return [c / total if total else 0.0 for c in counts]

    def distance(p, q):
        term = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(term(a, b) + term(b, a) for a, b in zip(p, q, strict=True)) / 2))

    measured = {}
    for doc_id, text, lang in rows:
        n, *_, repeated = quality_counts(text)
        measured[doc_id] = (lang, n, n < 50 or 100 * repeated > 50 * n, classes(text), bins(text), len(text))

    def learn(ids):
        found = {}
        for lang in {m[0] for m in measured.values()} - {None}:
            own = [measured[d] for d in ids if measured[d][0] == lang and not measured[d][2]]
            if len(own) >= rules.MIN_REFERENCE_DOCS:
                weights = [min(1.0, rules.PSEUDO_DOC_CHARS / max(m[5], 1)) for m in own]
                found[lang] = tuple(shares([sum(w * m[k][i] for w, m in zip(weights, own, strict=True)) for i in range(len(own[0][k]))]) for k in (3, 4))
        return found

    def judge(references):
        kept = {}
        for doc_id, (lang, n, failed, by_class, by_word, length) in measured.items():
            # A language without a reference meets the plain rules alone; without a language the nearest reference counts.
            refs = list(references.values()) if lang is None else [references[lang]] if lang in references else []
            near = lambda counts, k: min((distance(shares(counts), r[k]) for r in refs), default=0.0)  # noqa: E731, B023
            c = near(by_class, 0) if length >= rules.MIN_CLASS_CHARS else 0.0
            w = near(by_word, 1) if n >= rules.MIN_HISTOGRAM_WORDS else 0.0
            odd = c > rules.MAX_CLASS_DISTANCE or (c > rules.ODD_CLASS_DISTANCE and w > rules.ODD_WORD_DISTANCE)
            kept[doc_id] = not failed and not odd
        return kept

    first = judge(learn(measured))
    return judge(learn([d for d, k in first.items() if k]))
