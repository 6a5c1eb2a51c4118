"""Plain Python restatements of the operators' results, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs: list[tuple]) -> dict:
    first: dict = {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(zip(w, w[1:], w[2:]))
    at = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if counts[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


_BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _norm(text: str | None) -> list[str]:
    return _BENCH.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    pats = defaultdict(set)
    for i, t in items:
        w = _norm(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            pats[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(p) for p in pats}
    out = {}
    for d, t in docs:
        w, hit, who = _norm(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit.update(range(k, k + n))
                    who |= pats[p]
        out[d] = (len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w))
    return out


_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> tuple:
    text = text or ""
    got = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    got += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    got += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(x[1] for x in got)
    return n[0], n[1], n[2], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(got)))


def pieces_ok(docs: list[tuple], rows: list[dict], encode, limit: int = 2048) -> None:
    """Every id lies in one piece and every sequence is gapless and within the limit."""
    import zlib

    import numpy as np

    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, t in docs:
        ids, at = np.array([*encode(t or ""), 1], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit


def near_classes(docs: list[tuple], k: int = 5, similarity: float = 0.8) -> dict:
    """Least id of each document's component of shingle-set similarity, by way of all co-occurrences."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {("", t or "")}
    return _join(sets, similarity)


def _join(sets: dict, similarity: float) -> dict:
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in holders[s])
        for e, n in common.items():
            if n >= similarity * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: find(d) for d in sets}


def line_dedup(docs: list[tuple], k: int = 8, similarity: float = 0.8) -> dict:
    """Per document: lines with a word, removed lines, digest of what is left."""
    norm = lambda s: s.strip(" \t\x0b\x0c\r").lower()
    places = defaultdict(list)
    for d, t in sorted(docs):
        for i, line in enumerate((t or "").split("\n")):
            if norm(line):
                places[norm(line)].append((d, i))
    sets = {s: {s[i : i + k] for i in range(max(1, len(s) - k + 1))} for s in places}
    group = defaultdict(list)
    for s, r in _join(sets, similarity).items():
        group[r] += places[s]
    gone = {p for ps in group.values() for p in sorted(ps)[1:]}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if (d, i) not in gone]
        n = sum(bool(WORD.search(x)) for x in lines)
        out[d] = (n, len(lines) - len(left), sha("\n".join(left)))
    return out
