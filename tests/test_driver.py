"""What runs on the driver without Spark: plans, gates, models, JSON from prose, web search and fetches, telemetry."""

import pytest

from evidence_engine import telemetry
from evidence_engine.functions import jsonx
from evidence_engine.plans import models, research
from evidence_engine.sources import web

Q = research.Question


@pytest.mark.parametrize(
    "text, found",
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure!\n```json\n{"a": 1}\n```\nand {"b": 2}', {"a": 1}),
        ('He said "{" and then {"a": "}"} ok', {"a": "}"}),
        ('broken ] then {"a": [1, 2,],}', {"a": [1, 2]}),
        ("{'a': 'b'}", {"a": "b"}),
        ('[{"a": 1}]', {"items": [{"a": 1}]}),
        ("[1, 2]", None),
        ("{}", {}),
        ("no json { at all", None),
        ('{"a": "x\\"y{"}', {"a": 'x"y{'}),
        (None, None),
        ('{"n": {"m": [1, {"k": 2}]}} {"z": 1}', {"n": {"m": [1, {"k": 2}]}}),
    ],
)
def test_first_object_of_a_text(text, found):
    assert jsonx.extract_object(text) == found


class Scripted:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def complete(self, system, user):
        self.asked.append(user)
        return self.answers.pop(0)


def need_a(value):
    if "a" not in value:
        raise ValueError("a is missing")
    return value["a"]


def test_structured_output_is_repaired_then_given_up():
    client = Scripted("nothing", '{"b": 1}', '{"a": 5}')
    assert models.structured(client, "s", "u", need_a) == 5
    assert "no JSON object" in client.asked[1] and "a is missing" in client.asked[2]
    with pytest.raises(models.SchemaError):
        models.structured(Scripted("x", "y", "z"), "s", "u", need_a)


def test_only_passing_faults_are_tried_again():
    waits, faults = [], [OSError("HTTP 503"), OSError("read timed out")]

    def call():
        if faults:
            raise faults.pop(0)
        return "ok"

    assert models.with_retries(call, wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(models.ModelError):
        models.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad key")), wait=waits.append)
    assert waits == [1.0, 2.0]
    assert not models.supports_temperature("o3-mini") and models.supports_temperature("other")


def test_settings_come_from_file_environment_and_overrides(tmp_path):
    f = tmp_path / "env"
    f.write_text('# note\nEVIDENCE_MODEL="small"\nEVIDENCE_TOP_K=9\nEVIDENCE_SEARCH_ENDPOINTS=http://a, http://b\n')
    s = models.Settings.from_env(str(f), {"EVIDENCE_TOP_K": "4"}, model="", max_rounds=5, base_url=None)
    assert (s.model, s.top_k, s.search_endpoints, s.max_rounds, s.base_url) == ("small", 4, ("http://a", "http://b"), 5, "")


def test_plans_are_cut_and_ordered():
    plan = research.validate([Q(0, "a"), Q(1, "b", (0,)), Q(2, "c", (1,)), Q(3, "d", (2,)), Q(4, "e", (5,)), Q(5, "f", (4,))])
    assert [x.id for x in plan.questions] == [0, 1, 2] and len(plan.warnings) == 3
    assert [x.id for x in research.validate([Q(2, "b", (7, 2)), Q(1, "a"), Q(1, "again")]).questions] == [1, 2]
    assert not research.validate([Q(0, "only")]).multi_hop


def test_slots():
    assert research.fill_slots(Q(1, "Who led {{hop 0}} in {{ #2 }}?", (0,)), {0: "Acme"}) == "Who led Acme in ?"
    assert research.fill_slots(Q(1, "Who led it?", (0, 3)), {0: "Acme"}) == "Who led it? Acme"
    assert research.fill_slots(Q(1, "{{0}}", (0,)), {}) == "{{0}}"


def test_hops_pass_findings_on_and_note_faults():
    seen = []

    def retrieve(query, prefix):
        seen.append((query, prefix))
        return ([], None) if "nowhere" in query else ([f"{prefix}1", f"{prefix}2"], "text")

    def draft(question, evidence):
        if "fail" in question:
            raise models.ModelError("no answer")
        return [("Ingrid Halvorsen signed it", ("H0x1",))]

    plan = research.Plan((Q(0, "who signed"), Q(1, "what did {{0}} run", (0,)), Q(2, "nowhere"), Q(3, "fail"), Q(4, "late")))
    hops, warnings = research.run_hops(plan, retrieve, draft, lambda claims, e: claims, lambda texts: ["Ingrid Halvorsen"])
    assert seen[1] == ("what did Ingrid Halvorsen run", "H1x") and [h.note for h in hops] == ["", "", "no evidence retrieved", "research failed: no answer"]
    assert hops[0].coverage == 0.5 and research.plan_coverage(hops) == (0.25, 2, ["nowhere", "fail"]) and warnings == ["unanswered: nowhere", "unanswered: fail"]
    assert research.run_hops(plan, retrieve, draft, None, None, affordable=lambda: False)[1] == ["stopped after 0 hop(s): budget"]
    assert research.hop_coverage({"a", "b", "c", "d"}, 9) == 1.0 and research.plan_coverage([]) == (0.0, 0, [])


def test_gates_and_outcomes():
    assert research.can_answer("sufficient", "answer", 0.7) and not research.can_answer("sufficient", "answer", 0.5)
    assert not research.can_answer("insufficient", "answer", 1.0) and research.can_answer("partial", "answer", 0.0, claims=0) and not research.can_answer("partial", "widen_local", 1.0)
    assert research.should_abstain(1, 3, 0, 0.0, 0.2) and research.should_abstain(1, 3, 4, 0.1, 0.2)
    assert not research.should_abstain(0, 3, 0, 0.0, 0.2) and not research.should_abstain(1, 3, 4, 0.1, 0.0)
    assert research.outcome(abstained=True, budget=True) == "abstained" and research.outcome(budget=True, clean=False) == "budget"
    assert [research.outcome(stopped=True), research.outcome(clean=False), research.outcome(degraded=True), research.outcome()] == ["partial"] * 3 + ["answered"]
    assert research.is_terminal("clarify") and not research.is_terminal("web") and research.is_answer("partial") and not research.is_answer("budget")


def test_confidence_is_only_lowered_by_the_audit():
    c = research.confidence
    assert c("sufficient", 0.9) == "high" and c("sufficient", 0.6) == "medium" and c("insufficient", 0.9) == "low" and c("partial", 0.4) == "low"
    assert c("sufficient", 0.9, 0.7) == "medium" and c("sufficient", 0.9, 0.4) == "low" and c("sufficient", 0.9, 1.0, fabricated=1) == "low" and c("insufficient", 0.9, 1.0) == "low"
    assert c("sufficient", 0.9, 1.0, degraded=True) == "medium"


def test_routes():
    assert [research.available_route("hybrid", *x) for x in ((True, True), (False, True), (True, False), (False, False))] == ["hybrid", "web", "local", "local"]
    assert research.guarded_route("clarify", "local", None, True, 0.9) == "local" and research.guarded_route("clarify", "local", "Which?", True, 0.9) == "clarify"
    assert research.guarded_route("no_answer", "web", None, True, 0.0) == "web" and research.guarded_route("no_answer", "local", None, False, 0.1) == "no_answer"


def test_escalation_never_repeats_a_round():
    s = research.State("local", "q")
    assert research.escalate(s, "escalate_to_web", None, ["gap"], True) == research.State("hybrid", "q", 6, ("gap",))
    assert research.escalate(s, "escalate_to_web", None, [], True, corpus=False).route == "web"
    assert research.escalate(s, "refine_query", "q2", [], False) == research.State("local", "q2", 6)
    assert research.escalate(s, "refine_query", "q", [], False).top_k == 12 and research.escalate(s, "refine_query", None, [], True) == research.State("hybrid", "q", 12)
    assert research.escalate(research.State("web", "q", 20), "widen_local", None, list("abcdefgh"), True) == research.State("web", "q", 24, tuple("abcdef"))


class Audit:
    def __init__(self, clean):
        self.is_clean = clean


def test_synthesis_fails_closed():
    good, bad = Audit(True), Audit(False)

    def checker(*audits):
        left = list(audits)
        return lambda claims: (f"rendered {len(claims)}", claims[:1], left.pop(0))

    run = research.synthesize
    assert run(lambda p: [1, 2], None, checker(good), None, "F", "p") == ("rendered 2", good, False)
    assert run(lambda p: [1, 2], None, checker(bad, bad, good), None, "F", "p") == ("rendered 1", good, True)
    assert run(lambda p: [], None, checker(bad, bad), None, "F", "p") == ("F", bad, True)

    def broken(p):
        raise models.ModelError("down")

    texts = ["bad", "good"]
    assert run(broken, lambda p: texts.pop(0), None, lambda t: good if t != "bad" else bad, "F", "p") == ("good", good, False)
    assert run(None, lambda p: "bad", None, lambda t: good if t == "F" else bad, "F", "p") == ("F", good, True)
    assert run(None, broken, None, None, "F", "p") == ("F", None, True)
    assert research.rendered_claims([("a", ("S1", "S2"))]).endswith("- a [S1] [S2]") and "No drafted claim" in research.rendered_claims([])


def test_prompts_hold_what_they_are_given():
    assert models.rerank_prompt("q", ["p" * 2000]).count("p" * 1200) == 1 and "### Claim 3\nc" in models.entailment_prompt([(3, "c", "s")])
    assert "Measured route: web" in models.triage_prompt("q", "2 documents", ["t"], ["x"], "web", "why") and "web not available" in models.verifier_prompt("q", [], ["r"], "local", 1, 3, False)
    assert "Open gaps" not in models.synthesis_prompt("q", ["c"], "e", []) and "- fault" in models.resynthesis_prompt("p", ["fault"]) and "Evidence:\ne" in models.research_prompt("q", "e")


PUBLIC = {"ok.example": ["93.184.216.34"], "in.example": ["10.0.0.7"], "both.example": ["93.184.216.34", "127.0.0.1"]}


def resolve(host):
    if host in PUBLIC:
        return PUBLIC[host]
    raise OSError("unknown host")


def test_every_hop_of_a_fetch_is_checked():
    pages = {
        "http://ok.example/a": web.Reply(200, {"Content-Type": "text/html; charset=latin-1"}, "caf\xe9".encode("latin-1")),
        "http://ok.example/r": web.Reply(302, {"Location": "/a"}, b""),
        "http://ok.example/in": web.Reply(302, {"location": "http://in.example/"}, b""),
        "http://ok.example/loop": web.Reply(301, {"location": "/loop"}, b""),
        "http://ok.example/pdf": web.Reply(200, {"content-type": "application/pdf"}, b"x"),
        "http://ok.example/gone": web.Reply(404, {}, b"x"),
    }
    get = lambda url: web.fetch(url, lambda u, s: pages[u], resolve)
    assert get("http://ok.example/a") == get("http://ok.example/r") == "caf\xe9"
    assert [get(f"http://{x}") for x in ("ok.example/in", "ok.example/loop", "ok.example/pdf", "ok.example/gone", "both.example/", "nowhere.example/")] == [None] * 6
    assert get("ftp://ok.example/a") is None and not web.safe_url("http://[::1]/", lambda h: [h])


def test_search_goes_on_to_the_next_endpoint_and_waits_as_told():
    waits, calls = [], []
    replies = {"http://one": [web.Reply(429, {"Retry-After": "7"}, b""), web.Reply(503, {}, b""), web.Reply(200, {}, b"not json")], "http://two": [web.Reply(200, {}, b'{"results": [{"url": "http://x", "title": "T", "content": "C"}, {"title": "no url"}]}')]}

    def transport(url, seconds):
        calls.append(url)
        return replies[url.split("/search")[0]].pop(0)

    assert web.search_json("a b", ["http://one/", "http://two"], transport, wait=waits.append) == [("http://x", "T", "C", "")]
    assert waits == [7.0, 2.0] and calls[-1] == "http://two/search?q=a+b&format=json"
    page = b'<a rel="x" class="result__a" href="//d.example/l/?uddg=http%3A%2F%2Fok.example%2Fp&amp;z=1">A <b>t</b></a> <a class="result__snippet" href="y">S &amp; s</a>'
    assert web.search_html("q", lambda u, s: web.Reply(200, {}, page), "http://d.example/html/") == [("http://ok.example/p", "A t", "S & s", "html")]


def test_telemetry_without_a_tracer_does_nothing():
    seen = []
    with telemetry.span("x", a=1) as s:
        assert s is None
    telemetry.forwarded(seen.append)({"kind": "done"})
    assert seen == [{"kind": "done"}] and telemetry.plain_value([1, None]) == ["1", "None"] and telemetry.plain_value({"a": 1}) == "{'a': 1}"
