"""Driver-side plans over a few rows: question DAGs, routes, gates and outcomes. Models are injected."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from .models import ModelError

# Limits of a plan.
MAX_QUESTIONS, MAX_DEPTH = 6, 3


@dataclass(frozen=True)
class Question:
    id: int
    text: str
    depends_on: tuple[int, ...] = ()


@dataclass(frozen=True)
class Plan:
    questions: tuple[Question, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def multi_hop(self) -> bool:
        return len(self.questions) > 1


def validate(questions: Sequence[Question]) -> Plan:
    """At most 6 questions with distinct ids, no dangling, own or circular dependencies, at most 3 deep;
    what is cut is named. The questions come in an order in which dependencies precede."""
    warnings, seen = [], {}
    for q in questions[:MAX_QUESTIONS]:
        if q.id in seen or not q.text.strip():
            warnings.append(f"question {q.id}: repeated or empty")
        else:
            seen[q.id] = q
    if len(questions) > MAX_QUESTIONS:
        warnings.append(f"{len(questions) - MAX_QUESTIONS} questions over the limit")
    needs = {i: {d for d in q.depends_on if d in seen and d != i} for i, q in seen.items()}
    warnings += [f"question {i}: unknown or own dependency" for i, q in seen.items() if set(q.depends_on) - needs[i]]
    order, depth, open_ = [], {}, set(seen)
    while ready := sorted(i for i in open_ if not needs[i] & open_):
        for i in ready:
            depth[i] = 1 + max((depth[d] for d in needs[i] if d in depth), default=0)
            if depth[i] <= MAX_DEPTH and needs[i] <= set(order):
                order.append(i)
            else:
                warnings.append(f"question {i}: deeper than {MAX_DEPTH}")
        open_ -= set(ready)
    warnings += [f"question {i}: circular" for i in sorted(open_)]
    kept = tuple(Question(i, seen[i].text, tuple(sorted(needs[i]))) for i in order)
    return Plan(kept, tuple(warnings))


_SLOT = re.compile(r"\{\{\s*(?:hop|answer)?\s*#?\s*(\d+)\s*\}\}")


def fill_slots(question: Question, answers: dict[int, str]) -> str:
    """{{0}}, {{hop 0}} and {{answer #0}} become what earlier hops found, nothing where they found nothing; without a slot what the
    question depends on is appended."""
    out = _SLOT.sub(lambda m: answers.get(int(m[1]), ""), question.text)
    if not _SLOT.search(question.text):
        out = " ".join([out, *(answers[d] for d in question.depends_on if answers.get(d))])
    return " ".join(out.split()) or question.text


def hop_coverage(cited: set[str], evidence: int) -> float:
    """How well a hop was answered: distinct cited passages against up to three that were there."""
    return round(min(1.0, len(cited) / max(1, min(evidence, 3))), 3) if evidence and cited else 0.0


@dataclass
class Hop:
    question: Question
    query: str
    evidence: list[str] = field(default_factory=list)
    claims: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    note: str = ""

    @property
    def answered(self) -> bool:
        return bool(self.claims)

    @property
    def coverage(self) -> float:
        return hop_coverage({c for _, cites in self.claims for c in cites}, len(self.evidence))


def run_hops(plan: Plan, retrieve: Callable, draft: Callable, ground: Callable, terms: Callable, max_hops: int = 4, affordable: Callable[[], bool] = lambda: True) -> tuple[list[Hop], list[str]]:
    """Hops in order, each a job: (hops, warnings).

    retrieve(query, prefix) gives (ids, evidence), draft(question, evidence) claims, ground(claims, evidence) the pairs of
    supported text and citations, terms(texts) what to search for next. A hop that fails is noted; later ones go on."""
    hops, answers, warnings = [], {}, []
    for q in plan.questions[:max_hops]:
        if not affordable():
            warnings.append(f"stopped after {len(hops)} hop(s): budget")
            break
        hop = Hop(q, fill_slots(q, answers))
        hops.append(hop)
        hop.evidence, evidence = retrieve(hop.query, f"H{q.id}x")
        if not hop.evidence:
            hop.note = "no evidence retrieved"
            continue
        try:
            hop.claims = list(ground(draft(q.text, evidence), evidence))
        except ModelError as e:
            hop.note = f"research failed: {e}"
            continue
        hop.note = "" if hop.claims else "nothing grounded"
        found = terms([text for text, _ in hop.claims])
        answers[q.id] = ", ".join(found) if found else hop.claims[0][0][:120] if hop.claims else ""
    return hops, warnings + [f"unanswered: {h.question.text}" for h in hops if not h.answered]


def plan_coverage(hops: Sequence[Hop]) -> tuple[float, int, list[str]]:
    """Mean coverage, hops answered, and the questions that weren't."""
    mean = round(sum(h.coverage for h in hops) / len(hops), 3) if hops else 0.0
    return mean, sum(h.answered for h in hops), [h.question.text for h in hops if not h.answered]


# ---- routes, gates and outcomes ----------------------------------------------------------------------

TERMINAL, ANSWERS = ("clarify", "no_answer"), ("answered", "partial")


def is_terminal(route: str) -> bool:
    return route in TERMINAL


def is_answer(outcome: str) -> bool:
    return outcome in ANSWERS


def available_route(route: str, has_local: bool, has_web: bool) -> str:
    """A route made to fit what there is to search."""
    if has_local and has_web:
        return route
    return "web" if has_web else "local"


def guarded_route(route: str, suggested: str, clarifying_question: str | None, web: bool, coverage: float, weak: float = 0.28) -> str:
    """A model's route, unless it wants to clarify without a question, or gives up although there is something to search."""
    if route == "clarify" and not clarifying_question:
        return suggested
    if route == "no_answer" and (web or coverage > weak):
        return suggested
    return route


def can_answer(verdict: str, next_action: str, support_rate: float, minimum: float = 0.6, claims: int = 1) -> bool:
    """The verifier's word and the checked share of claims must agree; a draft without claims has no share to check."""
    says = (next_action == "answer" or verdict == "sufficient") and verdict != "insufficient"
    return says and (not claims or support_rate >= minimum)


def should_abstain(rounds: int, evidence: int, claims: int, support_rate: float, below: float) -> bool:
    """Is too little grounded to write an answer? Runs without rounds or evidence abstain elsewhere."""
    if not rounds or not evidence or below <= 0:
        return False
    return not claims or support_rate < below


def outcome(*, abstained: bool = False, budget: bool = False, stopped: bool = False, clean: bool = True, degraded: bool = False) -> str:
    """What a run ends as; the first that holds."""
    if abstained:
        return "abstained"
    if budget:
        return "budget"
    return "partial" if stopped or not clean or degraded else "answered"


def confidence(verdict: str, support_rate: float, verified_rate: float | None = None, fabricated: int = 0, degraded: bool = False) -> str:
    """high, medium or low. The audit of the answer (verified_rate, None if it checked nothing) can only lower it, and a
    fallback rendering is at most medium."""
    level = "high" if verdict == "sufficient" and support_rate >= 0.8 else "low" if verdict == "insufficient" or support_rate < 0.5 else "medium"
    if verified_rate is not None:
        if fabricated or verified_rate < 0.5:
            return "low"
        if verified_rate < 0.8 and level == "high":
            level = "medium"
    return "medium" if degraded and level == "high" else level


@dataclass(frozen=True)
class State:
    route: str
    query: str
    top_k: int = 6
    expansions: tuple[str, ...] = ()


def escalate(state: State, action: str, refined: str | None, gaps: Sequence[str], web: bool, corpus: bool = True, factor: int = 2) -> State:
    """The next round's state. Gaps always become expansions, at most 6. What the verifier asks for is done where it can be, else
    the search widens, up to 24 passages; a round is never the same as the one before if widening can help."""
    wider = min(24, state.top_k * factor)
    new = replace(state, expansions=tuple(dict.fromkeys([*state.expansions, *gaps]))[:6])
    if action == "escalate_to_web" and web:
        new = replace(new, route="hybrid" if corpus else "web")
    elif action == "refine_query" and refined:
        new = replace(new, query=refined)
    else:
        new = replace(new, top_k=wider)
        if action != "widen_local" and web and state.route == "local":
            new = replace(new, route="hybrid")
    return replace(new, top_k=wider) if new == state else new


def synthesize(structured: Callable[[str], list] | None, prose: Callable[[str], str], check_claims: Callable, check_text: Callable, fallback: str, prompt: str, corrected: Callable[[str, object], str] = lambda p, a: p) -> tuple[str, object | None, bool]:
    """(answer, audit, degraded): claims first, prose else, and only what was verified.

    structured(prompt) gives claims; check_claims(claims) gives (rendered text of those that stand, claims that stand,
    audit). prose(prompt) gives text; check_text(text) its audit. Audits have is_clean. Each way has two tries; a second unclean
    one ends in what stands, or in `fallback`, the rendering of the grounded claims."""
    if structured is not None:
        try:
            for attempt in range(2):
                text, standing, audit = check_claims(structured(prompt))
                if audit.is_clean or attempt:
                    if not standing:
                        return fallback, audit, True
                    return (text, audit, False) if audit.is_clean else (*_again(check_claims, standing), True)
        except ModelError:
            pass
    for _ in range(2):
        try:
            text = prose(prompt)
        except ModelError:
            return fallback, None, True
        audit = check_text(text)
        if audit.is_clean:
            return text, audit, False
        prompt = corrected(prompt, audit)
    return fallback, check_text(fallback), True


def _again(check_claims, standing):
    text, _, audit = check_claims(standing)
    return text, audit


def rendered_claims(claims: Sequence[tuple[str, Sequence[str]]]) -> str:
    """An answer of nothing but grounded claims (text, citations)."""
    if not claims:
        return "No drafted claim could be verified against the sources, so nothing here can be stated as fact."
    return "\n".join(["Based only on claims verified against the sources:", "", *(f"- {text} {' '.join(f'[{c}]' for c in cites)}" for text, cites in claims)])
