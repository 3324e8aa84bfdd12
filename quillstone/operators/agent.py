"""The control loop around retrieval: bounded searches, evidence budget, tool-call turns.

The loop itself is driver-side and tiny; every search it makes is a DataFrame
query the caller supplies.  Models are callables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

MAX_STEPS, MAX_SEARCHES, EVIDENCE_CHARS, MESSAGE_CHARS, MAX_QUESTION = 7, 8, 60_000, 120_000, 4_000
IDLE_SEARCHES = 2  #: searches in a row without new evidence that end the loop


@dataclass(frozen=True)
class Passage:
    """A search result: what evidence is made of."""

    chunk_id: str
    text: str
    location: str = ""


@dataclass
class EvidenceBook:
    """Evidence of one request: numbered in order of first sight, never twice, all of a batch or none."""

    limit: int = EVIDENCE_CHARS
    passages: dict[str, Passage] = field(default_factory=dict)

    def label(self, chunk_id: str) -> str:
        return f"E{list(self.passages).index(chunk_id) + 1}"

    def fresh(self, batch: Sequence[Passage]) -> list[Passage]:
        """The batch's unknown passages; ValueError if a known id comes with another text or an id is blank."""
        out: dict[str, Passage] = {}
        for p in batch:
            if not p.chunk_id:
                raise ValueError("a passage needs an id")
            known = self.passages.get(p.chunk_id) or out.get(p.chunk_id)
            if known and known != p:
                raise ValueError(f"{p.chunk_id} changed")
            if not known:
                out[p.chunk_id] = p
        return list(out.values())

    def context(self, extra: Sequence[Passage] = ()) -> str:
        every = [*self.passages.values(), *extra]
        return "\n\n".join(f"[E{n}]\nLocation: {p.location}\nText:\n{p.text}" for n, p in enumerate(every, 1))

    def add(self, batch: Sequence[Passage]) -> list[str]:
        """Labels of the new passages; OverflowError (and nothing added) when the context would exceed the limit."""
        new = self.fresh(batch)
        if len(self.context(new)) > self.limit:
            raise OverflowError("evidence_limit")
        self.passages.update((p.chunk_id, p) for p in new)
        return [self.label(p.chunk_id) for p in new]


@dataclass
class Outcome:
    answer: str
    stop: str  #: answered, no_progress, step_limit, search_limit, evidence_limit or context_limit
    steps: int
    searches: int
    history: list[dict]
    book: EvidenceBook


def checked_query(arguments: str | dict) -> str:
    """The query of a tool call's arguments; ValueError unless they are an object with one non-blank query of bounded length."""
    a = json.loads(arguments) if isinstance(arguments, str) else arguments
    if not isinstance(a, dict) or set(a) != {"query"} or not isinstance(a["query"], str):
        raise ValueError("invalid_arguments")
    q = a["query"].strip()
    if not q or len(q) > MAX_QUESTION:
        raise ValueError("invalid_arguments")
    return q


def run(
    question: str,
    queries: Sequence[str],
    search: Callable[[str, int, frozenset[str]], Sequence[Passage]],
    turn: Callable[[list[dict], bool], dict],
    top_k: int = 7,
    max_steps: int = MAX_STEPS,
    max_searches: int = MAX_SEARCHES,
    evidence_chars: int = EVIDENCE_CHARS,
) -> Outcome:
    """Search the planned queries, then let ``turn`` ask for more until it answers.

    ``search(query, k, seen)`` returns passages outside ``seen``;
    ``turn(messages, tools)`` returns {"text": …} or {"calls": [arguments, …]}.
    The first k places are shared among the planned queries, the earlier ones
    getting the remainder.  A search counts against the limit even if its
    arguments are invalid; the last step is without tools.
    """
    if not question.strip() or len(question) > MAX_QUESTION:
        raise ValueError("the question is blank or too long")
    book, history = EvidenceBook(evidence_chars), []
    messages: list[dict] = [{"role": "user", "content": question}]
    searches = idle = 0

    def one(arguments: str | dict, k: int) -> str | None:
        """Make one search; a reason to stop, or None."""
        nonlocal searches, idle
        if searches >= max_searches:
            messages.append({"role": "tool", "content": json.dumps({"error": "search_limit"})})
            return "search_limit"
        searches += 1
        try:
            q = checked_query(arguments)
            labels = book.add(search(q, k, frozenset(book.passages)))
            history.append({"query": q, "new": labels})
            content = {"new": labels}
        except OverflowError:
            messages.append({"role": "tool", "content": json.dumps({"error": "evidence_limit"})})
            return "evidence_limit"
        except ValueError as e:
            labels, content = [], {"error": str(e)}
        idle = 0 if labels else idle + 1
        messages.append({"role": "tool", "content": json.dumps(content)})
        return "no_progress" if idle >= IDLE_SEARCHES else None

    stop = None
    share, rest = divmod(top_k, max(1, len(queries)))
    for n, q in enumerate(queries):
        if k := share + (n < rest):
            stop = stop or one({"query": q}, k)
    for step in range(1, max_steps + 1):
        if sum(len(m["content"]) for m in messages) + len(book.context()) > MESSAGE_CHARS:
            return Outcome("", "context_limit", step - 1, searches, history, book)
        tools = stop is None and step < max_steps
        reply = turn([*messages, {"role": "evidence", "content": book.context()}], tools)
        calls = reply.get("calls") or []
        if not calls or not tools:
            return Outcome(reply.get("text", ""), stop or ("step_limit" if step == max_steps else "answered"), step, searches, history, book)
        for c in calls:
            stop = stop or one(c, top_k)
    return Outcome("", "step_limit", max_steps, searches, history, book)


def pick_cases(cases: Sequence[dict], count: int, order: Callable[[dict], object]) -> list[dict]:
    """``count`` evaluation cases, question types in turn and companies all different while that is possible; ``order`` makes the pick reproducible."""
    left = sorted(cases, key=order)
    kinds = sorted({c["question_type"] for c in left})
    out: list[dict] = []
    while left and len(out) < count:
        before = len(out)
        for kind in kinds:
            used = {c["company"] for c in out}
            mine = [c for c in left if c["question_type"] == kind]
            one = next((c for c in mine if c["company"] not in used), None)
            if one is not None and len(out) < count:
                out.append(one)
                left.remove(one)
        if len(out) == before:
            break
    return out
