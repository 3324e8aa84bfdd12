"""The control loop: quotas, exclusions, limits, atomic evidence."""

import pytest

from quillstone.operators import agent as A


def make(n):
    pool = [A.Passage(f"c{i}", f"text {i}") for i in range(n)]
    asked = []

    def search(q, k, seen):
        asked.append((q, k, set(seen)))
        return [p for p in pool if p.chunk_id not in seen][:k]

    return search, asked


def test_quota_and_exclusion():
    search, asked = make(9)
    turns = iter([{"calls": ['{"query": "more"}', {"query": "again"}]}, {"text": "done [E1]"}])
    out = A.run("q", ["a", "b"], search, lambda m, t: next(turns), top_k=3)
    assert [(q, k, len(s)) for q, k, s in asked] == [("a", 2, 0), ("b", 1, 2), ("more", 3, 3), ("again", 3, 6)]
    assert out.stop == "answered" and out.searches == 4 and out.steps == 2 and out.book.label("c8") == "E9"


def test_search_limit_counts_invalid():
    search, asked = make(50)
    out = A.run("q", ["a"], search, lambda m, t: {"calls": ['{"q": 1}', '{"query": "x"}']} if t else {"text": "end"}, top_k=1, max_searches=2)
    assert out.searches == 2 and out.stop == "search_limit" and len(asked) == 1


def test_no_progress_and_last_step():
    search, _ = make(0)
    assert A.run("q", ["a", "b"], search, lambda m, t: {"text": "none"} if not t else {"calls": [{"query": "z"}]}).stop == "no_progress"
    search, _ = make(1000)
    out = A.run("q", ["a"], search, lambda m, t: {"calls": [{"query": "z"}]} if t else {"text": "last"}, max_searches=99)
    assert out.stop == "step_limit" and out.answer == "last" and out.steps == A.MAX_STEPS


def test_evidence_is_atomic():
    b = A.EvidenceBook(limit=80)
    assert b.add([A.Passage("a", "x")]) == ["E1"] and b.add([A.Passage("a", "x"), A.Passage("b", "y")]) == ["E2"]
    for bad in ([A.Passage("c", "z"), A.Passage("a", "other")], [A.Passage("", "q")]):
        with pytest.raises(ValueError):
            b.add(bad)
    with pytest.raises(OverflowError):
        b.add([A.Passage("d", "w" * 99)])
    assert list(b.passages) == ["a", "b"]


def test_pick_cases():
    cases = [{"id": f"{t}{c}", "question_type": t, "company": c} for t in "xyz" for c in range(6)]
    got = A.pick_cases(cases, 6, lambda c: c["id"][::-1])
    assert len(got) == 6 == len({c["company"] for c in got}) and [c["question_type"] for c in got] == list("xyzxyz")
    assert got == A.pick_cases(cases[::-1], 6, lambda c: c["id"][::-1])
