"""Questions in words to structured requests, by a vocabulary of aliases; what is not understood is told, not guessed.

Aliases are matched longest first and do not overlap; each match is a constraint with its span. Words that no alias and
no filler explains make the parse incomplete, and an incomplete parse runs nowhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from factweave.operators.predicates import Filter
from factweave.plans.request import Request, Sort

#: Words that negate or join what stands before or between them, order it, or say nothing.
NEGATIONS = ("제외", "아닌", "빼고", "except", "excluding", "not in")
ALTERNATIVES = ("또는", "혹은", "이나", " or ", ",", "·")
DESCENDING, ASCENDING = ("높은", "큰", "많은", "내림차순", "highest", "largest", "descending"), ("낮은", "작은", "적은", "오름차순", "lowest", "smallest", "ascending")
FILLERS = ("알려줘", "보여줘", "찾아줘", "중에서", "중", "의", "을", "를", "은", "는", "이", "가", "와", "과", "에", "에서", "순으로", "순", "개", "show", "me", "the", "of", "by", "with", "and", "in", "list", "find", "a")
TOP = re.compile(r"(?:top|상위)\s*([0-9]{1,4})|([0-9]{1,4})\s*개")
#: Scales of Korean amounts; thresholds are read, but no field takes them.
AMOUNTS = {"조": 10**12, "억": 10**8, "만": 10**4, "": 1}
THRESHOLD = re.compile(r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(조|억|만)?\s*(원|%|퍼센트)\s*(이상|이하|초과|미만)")
COMPARISONS = {"이상": "gte", "이하": "lte", "초과": "gt", "미만": "lt"}
YEAR = re.compile(r"(?<![0-9])((?:19|20)[0-9]{2})\s*년")
MAX_TOP = 1000


@dataclass(frozen=True)
class Term:
    """What an alias means: a value of a field, a field to sort by or to show, a relation to a target, or a universe."""

    kind: str
    name: str
    value: object = None


@dataclass(frozen=True)
class Constraint:
    """A part of a question: its number in the order of the text, its words and what they mean."""

    key: str
    text: str
    start: int
    term: Term
    op: str = "eq"


@dataclass
class Parsed:
    """A question's constraints, the request they make, what was left unexplained, and thresholds no field takes."""

    constraints: list[Constraint] = field(default_factory=list)
    request: Request = field(default_factory=Request)
    residual: list[str] = field(default_factory=list)
    thresholds: list[tuple[str, float, str]] = field(default_factory=list)
    ambiguous: list[str] = field(default_factory=list)
    relations: list[tuple[str, object]] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return not (self.residual or self.ambiguous or self.thresholds)


def folded(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().casefold()


def matches(text: str, vocabulary: Mapping[str, Sequence[Term]]) -> list[tuple[int, int, str]]:
    """(start, end, alias) of aliases in a folded text: longest first, no two overlap; Latin ones as whole words."""
    found = []
    for alias in sorted({folded(a) for a in vocabulary if a.strip()}, key=lambda a: (-len(a), a)):
        edge = r"(?<![a-z0-9]){}(?![a-z0-9])" if alias.isascii() else "{}"
        for m in re.finditer(edge.format(re.escape(alias)), text):
            if all(m.end() <= s or m.start() >= e for s, e, _ in found):
                found.append((m.start(), m.end(), alias))
    return sorted(found)


def _follows(text: str, at: int, words: Sequence[str]) -> int | None:
    """Where one of the words ends that stands right after a place, a particle between them allowed."""
    m = re.match(r"\s*(?:을|를|은|는|이|가|의)?\s*(" + "|".join(map(re.escape, words)) + ")", text[at:])
    return at + m.end() if m else None


def parse(question: str, vocabulary: Mapping[str, Sequence[Term]]) -> Parsed:
    """A question by the aliases of a vocabulary; an alias with several meanings is ambiguous and means none."""
    text = folded(question or "")
    terms = {folded(a): list(dict.fromkeys(t)) for a, t in vocabulary.items()}
    out = Parsed()
    used = [False] * len(text)

    def use(a: int, b: int) -> None:
        used[a:b] = [True] * (b - a)

    for m in THRESHOLD.finditer(text):
        number = float(m[1].replace(",", "")) * (1 if m[3] in ("%", "퍼센트") else AMOUNTS[m[2] or ""])
        out.thresholds.append((COMPARISONS[m[4]], number, "PERCENT" if m[3] in ("%", "퍼센트") else "KRW"))
        use(*m.span())
    limit = None
    for m in TOP.finditer(text):
        if not any(used[m.start() : m.end()]):
            limit = int(m[1] or m[2])
            use(*m.span())
    free = "".join("\0" if u else c for c, u in zip(text, used))
    for start, end, alias in matches(free, terms):
        use(start, end)
        if len(terms[alias]) > 1:
            out.ambiguous.append(alias)
            continue
        op = "eq"
        if (after := _follows(free, end, NEGATIONS)) is not None:
            op = "ne"
            use(end, after)
        out.constraints.append(Constraint(f"C{len(out.constraints) + 1}", alias, start, terms[alias][0], op))
    filters: list[Filter] = []
    groups: dict[tuple[str, str], list[Constraint]] = {}
    for c in out.constraints:
        if c.term.kind == "value":
            groups.setdefault((c.term.name, c.op), []).append(c)
    for (name, op), parts in groups.items():
        values = tuple(dict.fromkeys(c.term.value for c in parts))
        joined = all(any(w.strip() in text[a.start + len(a.text) : b.start] for w in ALTERNATIVES) for a, b in zip(parts, parts[1:]))
        if len(values) == 1 or op == "ne":
            filters += [Filter(parts[0].key if len(values) == 1 else c.key, name, op, (v,)) for v, c in zip(values, parts)]
        elif joined:
            filters.append(Filter(parts[0].key, name, "in", values))
        else:
            out.ambiguous.append(name)  # two values at once, not said to be alternatives
    sorts, outputs, universe = [], [], "all"
    for c in out.constraints:
        if c.term.kind == "field":
            down, up = _follows(free, c.start + len(c.text), DESCENDING), _follows(free, c.start + len(c.text), ASCENDING)
            if down or up:
                use(c.start + len(c.text), down or up)
                sorts.append(Sort(c.term.name, bool(down)))
            else:
                outputs.append(c.term.name)
        elif c.term.kind == "relation":
            out.relations.append((c.term.name, c.term.value))
        elif c.term.kind == "universe":
            universe = c.term.name
    wishes = ("top",) if limit is not None and not sorts else ()
    if limit is not None and not 1 <= limit <= MAX_TOP:
        out.residual.append(f"top {limit}")
        limit = None
    fillers = sorted({*FILLERS, *(w.strip() for w in ALTERNATIVES)}, key=len, reverse=True)
    rest = "".join(" " if u else c for c, u in zip(text, used))
    for word in rest.split():
        plain = word.strip(".?!,·")
        while plain and (cut := next((f for f in fillers if plain == f or (not f.isascii() and plain.endswith(f))), None)):
            plain = plain[: -len(cut)]
        if plain:
            out.residual.append(word)
    out.request = Request(filters=tuple(filters), outputs=tuple(dict.fromkeys(outputs)), sort=tuple(sorts), limit=limit, wishes=wishes, universe=universe)
    return out


def maturity_range(text: str) -> tuple[str, str] | None:
    """First and last day of the year a text names."""
    m = YEAR.search(folded(text))
    return (f"{m[1]}-01-01", f"{m[1]}-12-31") if m else None


def route(parsed: Parsed, text_fields: Sequence[str] = ()) -> str:
    """Where a parse runs: the store alone only if it is complete and needs neither text nor graph."""
    if parsed.residual or parsed.ambiguous:
        return "INCOMPLETE"
    if parsed.thresholds:
        return "REFUSED"
    wants_text = any(f.field in text_fields for f in parsed.request.filters)
    return "FEDERATED" if parsed.relations or wants_text else "STORE"


def text_search(query: str, ignored: Sequence[str] = ()) -> str:
    """Lexical search for two or more Latin words of its own, else vectors."""
    words = [w for w in re.findall(r"[a-z][a-z0-9]+", folded(query)) if w not in ignored]
    return "bm25" if len(words) >= 2 else "vector"


def federated_steps(parsed: Parsed, text_query: str | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(step, source, needs) of a federated plan, the most selective source first: graph, then text, then the store.

    Later sources search only what earlier ones found; a merge keeps what all agree on.
    """
    steps: list[tuple[str, str, tuple[str, ...]]] = []
    for i, _ in enumerate(parsed.relations):
        steps.append((f"graph{i + 1}", "graph", tuple(s for s, *_ in steps)))
    if text_query:
        steps.append(("text", text_search(text_query), tuple(s for s, *_ in steps)))
    if parsed.request.filters or parsed.request.sort or not steps:
        steps.append(("store", "store", tuple(s for s, *_ in steps)))
    return steps + [("merge", "merge", tuple(s for s, *_ in steps))] if len(steps) > 1 else steps


def uncovered(parsed: Parsed, applied: Sequence[str]) -> list[str]:
    """Constraints of a question that a plan does not apply; must be empty before it runs."""
    return [c.key for c in parsed.constraints if c.term.kind in ("value", "relation") and c.key not in applied]
