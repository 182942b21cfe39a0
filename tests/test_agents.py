"""Logs of agents and sub-agents against a reading line by line."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tallyspark.sources import agents as A

NOW = datetime(2024, 5, 10, 12)
TARGETS = ["/w/a", "/w/b"]


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def meta(root, **k):
    return {"payload": {"kind": "metadata", "record": {"workspace_root": root}}, **k}


def branch(run, name, kind="branch", vcs="git", **k):
    return {"id": f"b{run}{name}", "payload": {"kind": "workspace_branch", "record": {"command_id": run, "vcs": vcs, "reference": {"kind": kind, "name": name}}}, **k}


def terminal(run, **k):
    return {"id": f"t{run}", "payload": {"kind": "run", "run_id": run, "event": {"kind": "terminal"}}, **k}


def linked(run, child, **k):
    return {"id": f"l{run}{child}", "payload": {"kind": "run", "run_id": "other", "event": {"kind": A.LINKED, "parent_run_id": run, "child_session_id": child}}, **k}


def call(record, run, at=NOW - timedelta(days=1), model="m", **usage):
    x = {"stream": {"id": "s"}, "recorded_at": micros(at) if at else 0, "payload": {"kind": "run", "run_id": run, "event": {"kind": "model_completed", "model": model, "usage": usage or {"input_tokens": 10, "output_tokens": 5, "cached_tokens": 4}}}}
    return {**x, "id": record} if record else x


def review(record, run, at=NOW - timedelta(days=1), **usage):
    return {"id": record, "payload": {"kind": "approval", "run_id": run, "event": {"kind": "automated_review_completed", "model": {"model_id": "rev"}, "usage": usage or {"input_tokens": 9, "output_tokens": 2}, "completed_at_ms": micros(at) // 1000}}}


def read(logs, mtimes, since=None):
    """path, record, branch, disposition, reason of every call; refusals by path and reason."""
    parsed, refused = {}, Counter()
    for path, lines in logs.items():
        s = {"root": "", "branches": {}, "ended": {}, "last": -1, "links": {}, "calls": [], "bad": Counter()}
        seen = set()
        for n, raw in enumerate(lines):
            try:
                x = json.loads(raw)
            except ValueError:
                s["bad"]["skipped_lines"] += 1
                continue
            p = x["payload"]
            e, rec = p.get("event", {}), p.get("record", {})
            if x.get("id"):
                s["last"] = n
            if p["kind"] in ("metadata", "workspace_branch") and not s["root"]:
                s["root"] = rec.get("workspace_root", "")
            if p["kind"] == "workspace_branch":
                ref = rec["reference"]
                s["branches"][rec["command_id"]] = ref["name"] if rec["vcs"] == "git" and ref["kind"] == "branch" else ""
            elif e.get("kind") == "terminal":
                s["ended"][p["run_id"]] = n
            elif e.get("kind") == A.LINKED:
                s["links"].setdefault(e["child_session_id"], set()).add(e.get("parent_run_id") or p["run_id"])
            elif e.get("kind") in ("model_completed", "automated_review_completed"):
                u = e["usage"]
                if any(not isinstance(v, int) for v in u.values()):
                    s["bad"]["undecodable_usage_record"] += 1
                    continue
                i, o, c = u.get("input_tokens"), u.get("output_tokens"), u.get("cache_read_tokens", u.get("cached_tokens", 0))
                model = e["model"] if p["kind"] == "run" else e["model"]["model_id"]
                at = x.get("recorded_at") or e.get("completed_at_ms", 0) * 1000
                wrong = i is None or o is None or any(not 0 <= v <= 1 << 29 for v in u.values()) or c + u.get("cache_write_tokens", 0) > i or u.get("reasoning_tokens", 0) > o or u.get("cached_tokens", c) != c
                why = "no_record_id" if not x.get("id") else "duplicate_record_id" if x["id"] in seen else "usage_identity_violation" if wrong else "zero_tokens" if not (i or o) else "no_model" if not model else "no_timestamp" if not at else None
                if why:
                    s["bad"][why] += 1
                else:
                    seen.add(x["id"])
                    s["calls"].append((x["id"], p["run_id"], datetime(1970, 1, 1) + timedelta(microseconds=at)))
        parsed[path] = s
    out = []
    for path, s in parsed.items():
        up = re.match(A.CHILD, path)
        parent = up and up[1] + "/session.jsonl"
        root = s["root"] if not up else parsed[parent]["root"] if parent in parsed and not re.match(A.CHILD, parent) else ""
        hit = next((t for t in TARGETS if root == t or root.startswith(t + "/")), None)
        state, why, of, run = None, None, s, None
        quiet_at = max(mtimes[path], mtimes[parent]) if parent in parsed else mtimes[path]
        quiet = NOW - quiet_at >= timedelta(hours=6)
        if root and not hit:
            state = "foreign"
        elif up and (parent not in parsed or root):
            links = parsed[parent]["links"].get(up[2], set()) if parent in parsed else set()
            why = "no_parent_log" if parent not in parsed else None if len(links) == 1 else "no_link" if not links else "ambiguous_link"
            if why:
                state = "unlinked_excluded" if quiet else "unlinked_held"
            else:
                of, run = parsed[parent], next(iter(links))
        if not state and not hit:
            state = "no_workspace_root"
        if state != "foreign":
            refused.update({(path, k): n for k, n in s["bad"].items()})
        for record, own, at in s["calls"]:
            r = run if up and run else own
            fate, name, reason = state, None, why
            if not fate and at > NOW + timedelta(days=1):
                fate, reason = "refused", "timestamp_beyond_clock_horizon"
            elif not fate and since and at < since:
                fate = "earlier"
            elif not fate:
                gone = r in of["ended"] and of["last"] > of["ended"][r]
                fate = "held" if r not in of["branches"] and not gone and not quiet else "emitted"
                name = of["branches"].get(r, "") if fate == "emitted" else None
            out.append((path, record, name, fate, reason if fate != "emitted" else None))
    return sorted(out, key=repr), refused


def check(spark, logs, mtimes, since=None):
    lines = [(p, n, v) for p, vs in logs.items() for n, v in enumerate(vs)]
    targets = spark.createDataFrame([(t, i) for i, t in enumerate(TARGETS)], "target string, place long")
    s = A.sessions(spark.createDataFrame(lines, "path string, line long, value string"), spark.createDataFrame(list(mtimes.items()), "path string, modified_at timestamp_ntz"), targets, spark.createDataFrame([], "root string, main string"), str(NOW), str(since) if since else None)
    calls, refused = read(logs, mtimes, since)
    got = s.calls.collect()
    assert sorted(((r.path, r.record_id, r.branch, r.disposition, r.reason) for r in got), key=repr) == calls
    assert {(r.path, r.reason): r.n for r in s.refused.collect()} == refused
    return {r.record_id: r for r in got}, refused


OLD, FRESH = NOW - timedelta(days=2), NOW - timedelta(minutes=5)



def test_levels_links_and_orphans(spark):
    main, child, deep = "/m/1/session.jsonl", "/m/1/subagent/c/session.jsonl", "/m/1/subagent/c/subagent/d/session.jsonl"
    logs = {
        main: [meta("/w/a/x"), call("r1", "A"), branch("A", "old"), branch("A", "feat/7"), linked("A", "c"), linked("A", "two"), linked("B", "two"), call("r2", "T"), branch("T", "v1", "tag")],
        child: [meta("/elsewhere"), call("r3", "mine"), linked("mine", "d")],
        deep: [meta("/w/a"), call("r4", "z")],
        "/m/1/subagent/two/session.jsonl": [call("r5", "z")],
        "/m/1/subagent/none/session.jsonl": [call("r6", "z")],
        "/m/2/subagent/c/session.jsonl": [call("r7", "z")],
        "/m/3/session.jsonl": [meta("/x"), call("r8", "A"), "{"],
        "/m/4/session.jsonl": [call("r9", "A"), "not json"],
    }
    logs = {k: [x if isinstance(x, str) else json.dumps(x) for x in v] for k, v in logs.items()}
    got, refused = check(spark, logs, {p: OLD for p in logs})
    assert [(got[r].branch, got[r].disposition) for r in ("r1", "r2", "r3")] == [("feat/7", "emitted"), ("", "emitted"), ("feat/7", "emitted")]
    assert [got[r].disposition for r in ("r4", "r8", "r9")] == ["no_workspace_root", "foreign", "no_workspace_root"]
    assert [got[r].reason for r in ("r5", "r6", "r7")] == ["ambiguous_link", "no_link", "no_parent_log"]
    assert (got["r4"].depth, got["r4"].top, got["r3"].target, got["r3"].session_id) == (2, main, "/w/a", "s")
    assert refused == {("/m/4/session.jsonl", "skipped_lines"): 1}
    fresh, _ = check(spark, logs, {p: FRESH for p in logs}, NOW - timedelta(hours=1))
    assert fresh["r5"].disposition == "unlinked_held" and fresh["r1"].disposition == "earlier"


def test_records_that_cannot_be_billed(spark):
    usages = [{"input_tokens": 1}, {"input_tokens": 5, "output_tokens": 1, "cached_tokens": 6}, {"input_tokens": 5, "output_tokens": 1, "reasoning_tokens": 2}, {"input_tokens": -1, "output_tokens": 1}, {"input_tokens": 0, "output_tokens": 0}, {"input_tokens": "many", "output_tokens": 1}, {"input_tokens": 5, "output_tokens": 1, "cached_tokens": 2, "cache_read_tokens": 3}, {"input_tokens": 1 << 30, "output_tokens": 1}]
    lines = [call(f"r{i}", "A", **u) for i, u in enumerate(usages)]
    lines += [call(None, "A"), call("same", "A", model=""), call("same", "A"), call("same", "A", **usages[0]), call("same", "A"), call("late", "A", at=NOW + timedelta(days=3)), call("never", "A", at=None), review("v", "A"), review("v2", "A", input_tokens=3, output_tokens=1, non_cached_input_tokens=3, total_tokens=4)]
    path = "/m/1/session.jsonl"
    got, refused = check(spark, {path: [json.dumps(x) for x in [meta("/w/b"), *lines]]}, {path: OLD})
    assert {r: got[r].disposition for r in got} == {"same": "emitted", "late": "refused", "v": "emitted", "v2": "emitted"}
    assert (got["v"].kind, got["v"].model, got["v"].input_tok) == ("review", "rev", 9) and got["same"].input_tok == 6
    assert {k[1] for k in refused} == {"usage_identity_violation", "zero_tokens", "undecodable_usage_record", "no_record_id", "no_model", "duplicate_record_id", "no_timestamp"}


@pytest.mark.parametrize("seed", range(2))
def test_random_logs(spark, seed):
    r = random.Random(seed)
    logs, mtimes, n = {}, {}, 0
    for m in range(8):
        for sub in ("", "/subagent/c1", "/subagent/c2", "/subagent/c1/subagent/c2"):
            if r.random() < 0.2:
                continue
            path, lines = f"/m/{m}{sub}/session.jsonl", []
            for _ in range(r.randrange(1, 14)):
                n, run = n + 1, r.choice("AB")
                lines.append(r.choice([lambda: meta(r.choice(["/w/a", "/w/b/c", "/v", "/w/ab"])), lambda: branch(run, f"f{n}", r.choice(["branch", "tag"])), lambda: terminal(run), lambda: linked(run, r.choice(["c1", "c2"])), lambda: call(f"r{r.randrange(6)}", run), lambda: call(f"r{n}", run), lambda: review(f"v{n}", run)])())
            logs[path], mtimes[path] = [json.dumps(x) for x in lines], r.choice([OLD, FRESH])
    got, _ = check(spark, logs, mtimes)
    assert {x.disposition for x in got.values()} >= {"emitted", "foreign"}


def test_no_logs(spark):
    assert check(spark, {}, {})[0] == {}
