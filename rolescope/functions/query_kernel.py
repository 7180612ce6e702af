"""Arrow-batch evaluation of a bounded query set against posting text.

Runs inside tasks on the columns prepared by `operators.query_match`. A token's contained terms
depend on the token alone, so they are looked up once per distinct token and remembered; per
posting, the queries of all hit terms are counted with numpy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

TOKEN_ONLY = re.compile(r"[a-z0-9+#]+")
MEMO_LIMIT = 1 << 18  # tokens a worker remembers
START = 3  # characters by which terms are found inside a token
NOTHING = ((), -1)
SEPARATOR = "\x00"


def _run(text: str) -> str:
    """The tokens of a text, each between spaces; empty without a token."""
    tokens = TOKEN_ONLY.findall(text.lower())
    return f" {' '.join(tokens)} " if tokens else ""


@dataclass(frozen=True)
class Limits:
    score: float
    title_overlap: float
    overlap: float


class QuerySet:
    """Queries of one profile set, indexed by term, token, title and location."""

    def __init__(self, queries: list[dict], limits: Limits, whole_word: bool):
        self.queries = sorted(queries, key=lambda q: (q["pid"], q["ord"]))
        self.limits, self.whole_word = limits, whole_word
        n = len(self.queries)
        terms = sorted({x for q in self.queries for x in q["terms"]})
        words = sorted({x for q in self.queries for x in q["tokens"]})
        simple = [x for x in terms if TOKEN_ONLY.fullmatch(x)]
        self.term_id = {x: i for i, x in enumerate(terms)}
        self.word_id = {x: i for i, x in enumerate(words)}
        self.simple = set(simple)
        # other terms: a run of whole tokens, or a substring of the text
        self.loose = [(_run(x) if whole_word else x, self.term_id[x]) for x in terms if x not in self.simple]
        self.loose = [(x, i) for x, i in self.loose if x or not whole_word]  # the empty term lies in every text
        # lengths of the terms below START, and of the others by how they start
        self.short = sorted({len(x) for x in simple if len(x) < START})
        starts: dict[str, set[int]] = {}
        for x in simple:
            if len(x) >= START:
                starts.setdefault(x[:START], set()).add(len(x))
        self.starts = {x: sorted(sizes) for x, sizes in starts.items()}
        # queries per term (a query counts as often as it lists the term), and per word
        listed, has_term, has_word = [[] for _ in terms], [[] for _ in terms], [[] for _ in words]
        for j, q in enumerate(self.queries):
            for x in q["terms"]:
                listed[self.term_id[x]].append(j)
            for x in q["term_set"]:
                has_term[self.term_id[x]].append(j)
            for x in q["tokens"]:
                has_word[self.word_id[x]].append(j)
        self.listed, self.has_term, self.has_word = (
            [np.array(at, dtype=np.int64) for at in lists] for lists in (listed, has_term, has_word))
        self.n_terms = np.array([max(len(q["term_set"]), 1) for q in self.queries], dtype=float)
        self.n_tokens = np.array([len(q["tokens"]) for q in self.queries], dtype=float)
        self.titles = self._by_value("title_n")
        self.places = self._by_value("location_n")
        pids = [q["pid"] for q in self.queries]
        starts = [j for j in range(n) if j == 0 or pids[j] != pids[j - 1]]
        self.ranges = list(zip(starts, starts[1:] + [n]))
        self.memo: dict[str, tuple] = {}

    def _count(self, queries_of: list[np.ndarray], ids: list[int]) -> np.ndarray:
        """How many of the given terms or words every query has."""
        if not ids:
            return np.zeros(len(self.queries))
        return np.bincount(np.concatenate([queries_of[i] for i in ids]), minlength=len(self.queries)).astype(float)

    def _by_value(self, name: str) -> list[tuple[str, np.ndarray]]:
        found: dict[str, list[int]] = {}
        for j, q in enumerate(self.queries):
            if q[name] is not None:
                found.setdefault(q[name], []).append(j)
        return [(value, np.array(at)) for value, at in found.items()]

    def _contained(self, token: str) -> tuple:
        """(ids of the terms inside this token, id of the token itself as a query word)."""
        known = self.memo.get(token)
        if known is None:
            if self.whole_word:
                inside = {self.term_id[token]} if token in self.simple else set()
            else:
                inside = set()
                for i in range(len(token)):
                    for size in (*self.short, *self.starts.get(token[i:i + START], ())):
                        piece = token[i:i + size]
                        if len(piece) == size and piece in self.simple:
                            inside.add(self.term_id[piece])
            word = self.word_id.get(token, -1)
            known = (tuple(inside), word) if inside or word >= 0 else NOTHING
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            self.memo[token] = known
        return known

    def _terms_in(self, tokens: list[str], text: str) -> tuple[list[int], list[int]]:
        found = [self.memo.get(token) or self._contained(token) for token in tokens]
        found = [known for known in found if known is not NOTHING]
        terms = set().union(*[inside for inside, _ in found])
        words = [word for _, word in found if word >= 0]
        if self.loose:
            text = SEPARATOR.join(map(_run, text.split("\x00"))) if self.whole_word else text
            terms.update(i for x, i in self.loose if x in text)
        return sorted(terms), words

    def best(self, title: str, place: str, probe: str, full: str, words: str, n_tokens: int) -> list[dict]:
        """Best query per profile for one posting."""
        n = len(self.queries)
        hit_terms, hit_words = self._terms_in(words.split(), full)
        near_terms, _ = self._terms_in(TOKEN_ONLY.findall(probe), probe)
        common = self._count(self.has_word, hit_words)
        overlap = self._count(self.has_term, hit_terms) / self.n_terms
        domain = self._count(self.listed, near_terms) / self.n_terms
        with np.errstate(invalid="ignore", divide="ignore"):
            similar = np.where(common == 0, 0.0, common / (self.n_tokens + n_tokens - common))
        title_hit, place_hit, phrase = np.zeros(n), np.zeros(n), np.zeros(n)
        for value, at in self.titles:
            if value in title:
                title_hit[at] = 1.0
        for value, at in self.places:
            if value in place:
                place_hit[at] = 1.0
        # every inner word of a contained phrase is a whole token of the text
        for j in np.flatnonzero(common >= self.n_tokens - 2):
            text = self.queries[j]["text_n"]
            phrase[j] = float(bool(text) and text in full)
        total = title_hit * 0.35 + domain * 0.25 + place_hit * 0.10 + overlap * 0.20 + similar * 0.10 + phrase * 0.10
        shown = np.rint(total * 100.0 * 100.0) / 100.0
        out = []
        for lo, hi in self.ranges:
            j = lo + int(np.argmax(shown[lo:hi]))
            q = self.queries[j]
            passed = total[j] >= self.limits.score
            out.append({
                "pid": q["pid"],
                "best": {
                    "best_query_score": float(shown[j]), "neg_ord": -q["ord"],
                    "matched": bool(
                        passed or (title_hit[j] >= 1 and overlap[j] >= self.limits.title_overlap)
                        or overlap[j] >= self.limits.overlap),
                    "best_query": q["text"],
                    "best_query_similarity": float(np.rint(similar[j] * 10000.0) / 10000.0),
                    "best_query_title_score": float(title_hit[j]),
                    "best_query_domain_score": float(np.rint(domain[j] * 10000.0) / 10000.0),
                    "best_query_location_score": float(place_hit[j]),
                    "best_query_term_overlap": float(np.rint(overlap[j] * 10000.0) / 10000.0),
                    "decision_reason": "passed threshold" if passed else "below threshold",
                },
            })
        return out


_ready: dict[tuple, QuerySet] = {}


def query_set(token: str, queries: list[dict], limits: Limits, whole_word: bool) -> QuerySet:
    """One QuerySet per worker process and query set, kept with what it has learned about tokens."""
    key = (token, limits, whole_word)
    if key not in _ready:
        if len(_ready) >= 4:
            _ready.clear()
        _ready[key] = QuerySet(queries, limits, whole_word)
    return _ready[key]
