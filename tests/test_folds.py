"""Order-aware operators against plain folds over random sequences."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline import constants as K
from siftline.operators import audit as AU, digests as DG, guard as GD, ordered as OR, patterns as PT, shortlist as SL, tactics as TC

T0 = datetime(2024, 1, 1)


def at(seq: int) -> datetime:
    return T0 + timedelta(seconds=seq)


# --- building blocks --------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 1000])
def test_running_equals_plain_loop(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), s, rng.choice([None, 1, 2, 5])) for s in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    v = F.col("v")
    out = OR.running(df, ["k"], "seq", block, sums={"s": v}, maxes={"m": v}, lasts={"l": v}, lags={"p": v}).collect()
    got = {(r.k, r.seq): (r.s, r.m, r.l, r.p) for r in out}
    want, state = {}, defaultdict(lambda: [0, None, None, None])
    for k, s, x in sorted(rows, key=lambda r: r[1]):
        st = state[k]
        if x is not None:
            st[0], st[1], st[2] = st[0] + x, x if st[1] is None else max(st[1], x), x
        want[(k, s)] = (st[0], st[1], st[2], st[3])
        st[3] = x
    assert got == want


def test_top_k_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), s, rng.randrange(9)) for s in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {(r.k, r.seq, r.pos) for r in OR.top_k(df, ["k"], [F.desc("v"), F.asc("seq")], 17, "seq", rank="pos").collect()}
    want = set()
    for k in "ab":
        best = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:17]
        want |= {(k, r[1], i) for i, r in enumerate(best, 1)}
    assert got == want


# --- shortlist --------------------------------------------------------------------------------------


def number(price):
    m = re.search(r"\d+[.,]?\d*", (price or "").replace(" ", ""))
    return float(m.group().replace(",", ".")) if m else None


def fold_shortlist(rows):
    """One entry per (run, key): every row replaces the entry it finds."""
    entries = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        key, url, price = (r["run_id"], r["name_key"]), r["source_url"].strip(), r["price"]
        old = entries.get(key)
        if old is None:
            entries[key] = dict(name=r["name"], urls=[url] if url else [], price=price or "", details=r["details"][:1200], session=r["session"], seq=r["seq"])
            continue
        e = dict(old, seq=r["seq"])
        if len(r["name"]) >= len(old["name"]):
            e["name"] = r["name"]
        if url and url not in old["urls"]:
            e["urls"] = old["urls"] + [url]
        new, held = number(price), number(old["price"])
        keep = new is not None and held is not None and held <= new
        if not keep and price is not None and price.strip():
            e["price"] = price
        d = r["details"].strip()
        if len(d) >= len(old["details"]):
            e["details"] = d[:1200]
        e["session"] = r["session"] or old["session"]
        listed = K.LIST_URL_HINTS
        e["urls"] = sorted(e["urls"], key=lambda u: (not any(w in u.lower() for w in listed), len(u.lower().split("?")[0])), reverse=True)
        entries[key] = e
    return entries


def test_merge_equals_fold(spark):
    rng = random.Random(11)
    rows = []
    for seq in range(900):
        rows.append(
            dict(
                run_id=rng.randrange(4), seq=seq, ts=at(seq), session=rng.choice(["", "s1", "s2"]),
                name=rng.choice(["Hotel Abc", "abc", "ABC spa", "The Xyz", "xyz  hotel"]),
                source_url=rng.choice(["", " ", "http://a/search?x=1", "http://a/b", "http://a/c", "http://a/longer/path", "http://a/b?sort=1"]),
                price=rng.choice([None, "", "  ", "on request", "€ 12", "12,0", "€ 9,50", "30 EUR", "1 299"]),
                details=rng.choice(["", " x ", "pool", " pool and beach ", "d" * 1199, " " + "e" * 1300 + " ", "f" * 1200]),
                match_status="full", matched=[], unmatched=[], unknown=[],
            )
        )
    schema = "run_id long, seq long, ts timestamp_ntz, session string, name string, source_url string, price string, details string, match_status string, matched array<string>, unmatched array<string>, unknown array<string>"
    checked = SL.check_candidates(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    ok = SL.accepted(checked)
    by_seq = {r["seq"]: r for r in rows}
    kept = [dict(by_seq[r.seq], name=r.name, name_key=r.name_key) for r in ok.select("seq", "name", "name_key").collect()]
    assert all(r["source_url"].strip() or (r["price"] or "").strip() for r in kept) and len(kept) < len(rows)
    want = fold_shortlist(kept)
    got = {(r.run_id, r.name_key): r for r in SL.shortlist_items(SL.merge_candidates(ok), SL.candidate_urls(ok)).collect()}
    assert got.keys() == want.keys()
    for key, e in want.items():
        g = got[key]
        assert (g["name"], g.source_urls, g.price, g.details, g.session, g.last_seq) == (e["name"], e["urls"], e["price"], e["details"], e["session"], e["seq"]), key
        assert g.source_url == (e["urls"][0] if e["urls"] else "")


# --- tactics ----------------------------------------------------------------------------------------


def fold_tactics(rows, prior):
    held = {d: dict(v) for d, v in prior.items()}
    for seq, tool, url, ok, error, blocked in sorted(rows):
        d = url.split("//")[1].split("/")[0]
        old = held.get(d, {})
        if tool == "web_fetch" and (blocked or "403" in (error or "")):
            reason = "HTTP fetch blocked or 403"
        elif tool == "browser_open" and ok and (old.get("tool") == "browser_open" or blocked):
            reason = old.get("reason") or "browser succeeded"
        else:
            continue
        held[d] = dict(tool="browser_open", reason=reason, last=at(seq), n=old.get("n", 0) + 1)
    return {d: (v["tool"], v["reason"], v["last"], v["n"]) for d, v in held.items()}


@pytest.mark.parametrize("with_prior", [False, True])
def test_tactics_equal_fold(spark, with_prior):
    rng = random.Random(3 + with_prior)
    rows = [
        (s, rng.choice(["web_fetch", "browser_open", "browser_open", "web_search"]), f"http://d{rng.randrange(25)}.be/x", rng.random() < 0.6,
         rng.choice([None, None, None, "HTTP 403", "timeout"]), rng.random() < 0.15)
        for s in range(160)
    ]
    prior = {}
    if with_prior:
        prior = {
            "d1.be": dict(tool="browser_open", reason="", last=T0, n=4),
            "d2.be": dict(tool="web_fetch", reason="kept", last=T0, n=2),
            "other.be": dict(tool="browser_open", reason="r", last=T0, n=1),
        }
    df = spark.createDataFrame([(s, at(s), t, u, o, e, b) for s, t, u, o, e, b in rows], "seq long, ts timestamp_ntz, tool string, url string, ok boolean, error string, blocked boolean")
    old = None
    if prior:
        old = spark.createDataFrame(
            [(d, v["tool"], v["reason"], v["last"], v["n"], i) for i, (d, v) in enumerate(prior.items())],
            "domain string, preferred_tool string, reason string, last_verified timestamp_ntz, success_count long, pos long",
        )
    got = {r.domain: (r.preferred_tool, r.reason, r.last_verified, r.success_count) for r in TC.learn_tactics(df, old).collect()}
    assert got == fold_tactics(rows, prior)


def test_lookup_prefers_own_then_earliest_parent(spark):
    tactics = spark.createDataFrame([("b.c", "t1", 5), ("a.b.c", "t2", 9), ("c", "t3", 1)], "domain string, preferred_tool string, pos long")
    events = spark.createDataFrame([(1, "http://a.b.c/"), (2, "http://x.b.c/"), (3, "http://xb.c/"), (4, "http://d/"), (5, None)], "seq long, url string")
    got = {r.seq: r.preferred_tool for r in TC.with_preferred_tool(events, tactics).collect()}
    assert got == {1: "t2", 2: "t3", 3: "t3", 4: None, 5: None}


# --- URL patterns -----------------------------------------------------------------------------------


def fold_patterns(rows, prior=None):
    held = {d: [list(x) for x in v[:3]] + [v[3]] for d, v in (prior or {}).items()}
    for d, path, names in rows:
        e = held.setdefault(d, [[], [], [], 0])
        e[0] = (e[0] + [n for n in dict.fromkeys(names) if n not in e[0]])[:40]
        if path not in e[1]:
            e[1] = [path, *e[1]][:8]
        query = "&".join(f"{n}=…" for n in list(dict.fromkeys(names))[:15])
        example = f"http://{d}{path}" + (f"?{query}" if query else "")
        if example not in e[2]:
            e[2] = [example, *e[2]][:5]
        e[3] += 1
    return {d: tuple(map(tuple, e[:3])) + (e[3],) for d, e in held.items()}


@pytest.mark.parametrize("with_prior", [False, True])
def test_patterns_equal_fold_with_evictions(spark, with_prior):
    rng = random.Random(7)
    rows = []
    for s in range(700):
        d = f"d{rng.randrange(4)}.be"
        span = {"d0.be": 3, "d1.be": 9, "d2.be": 14, "d3.be": 40}[d]
        names = [f"date{rng.randrange(3 if d != 'd3.be' else 60)}" for _ in range(rng.randrange(3))]
        rows.append((d, f"/search/{rng.randrange(span)}", names))
    url = lambda d, p, names: f"http://{d}{p}" + ("?" + "&".join(f"{n}=1" for n in names) if names else "")
    seen = [(s, at(s), url(*r), "browser_open", None if s % 2 else "", ["€ 1"] if s % 3 else []) for s, r in enumerate(rows)]
    # Results of other tools, with an error, or without prices and any mention of a search teach nothing.
    seen += [(s, at(s), "http://d1.be/search/never?date=1", *x) for s, x in enumerate([("web_fetch", None, ["€ 1"]), ("browser_open", "Timeout", ["€ 1"])])]
    seen += [(9, at(9), "http://d1.be/results/never?date=1", "browser_open", None, [])]
    visits = spark.createDataFrame(seen, "seq long, ts timestamp_ntz, url string, tool string, error string, price_hints array<string>")
    cut = 350 if with_prior else 0
    prior_df = PT.learn_patterns(visits.filter(F.col("seq") < cut)) if with_prior else None
    out = PT.learn_patterns(visits.filter(F.col("seq") >= cut), prior_df).collect()
    got = {r.domain: (tuple(r.param_names), tuple(r.path_hints), tuple(r.example_urls), r.success_count) for r in out}
    assert got == fold_patterns(rows)


def test_pattern_match_directions(spark):
    pats = spark.createDataFrame(
        [("b.c", 3, ["p"], ["/x"]), ("m.shop.be", 1, [], ["/y"]), ("n.shop.be", 0, [], ["/z"])],
        "domain string, pos long, param_names array<string>, path_hints array<string>",
    )
    hosts = spark.createDataFrame([("b.c",), ("a.b.c",), ("shop.be",), ("xb.c",), ("",)], "host string")
    assert {r.host: r.pattern_key for r in PT.match_patterns(hosts, pats).collect()} == {"b.c": "b.c", "a.b.c": "b.c", "shop.be": "n.shop.be"}


# --- digests ----------------------------------------------------------------------------------------


def test_budget_stops_at_the_first_overflow(spark):
    notes = [(1, "s", i, "n", "t", "", "x" * n, True) for i, n in enumerate([50, 400, 5])]
    df = spark.createDataFrame(notes, "run_id long, session string, seq long, source_type string, title string, url string, summary string, ok boolean")
    line = lambda n: "- [n] t: " + "x" * n + " {session:s}"
    got = DG.notes_digest(df, ["run_id"], max_chars=200).first().digest
    assert got == line(50) + "\n...[more notes truncated]"
    assert DG.notes_digest(df, ["run_id"], max_chars=2000).first().digest == "\n".join(map(line, [50, 400, 5]))
    assert DG.notes_digest(df, ["run_id"], max_chars=10).first().digest == "...[more notes truncated]"


def test_handoff_falls_back_to_the_last_notes(spark):
    notes = [(1, "a", i, "n", f"t{i}", "", "s", True) for i in range(20)]
    df = spark.createDataFrame(notes, "run_id long, session string, seq long, source_type string, title string, url string, summary string, ok boolean")
    sessions = spark.createDataFrame([(1, "a"), (1, "quiet"), (2, "none")], "run_id long, session string")
    got = {(r.run_id, r.session): r.digest for r in DG.session_handoff(df, sessions).collect()}
    assert got[(1, "a")].count("\n") == 19 and got[(1, "quiet")].count("\n") == 14
    assert got[(1, "quiet")].startswith("- [n] t5:") and got[(2, "none")] == "(no notes yet)"


# --- audits -----------------------------------------------------------------------------------------


def test_streaks_over_small_blocks(spark):
    rng = random.Random(2)
    rows = [(s, 1, rng.randrange(3), "browser_click", f"http://h/{rng.randrange(2)}", None, rng.random() < 0.5, False, rng.choice([None, None, "e"]), [str(x) for x in range(rng.randrange(3))]) for s in range(200)]
    df = spark.createDataFrame(rows, "seq long, run_id long, session_id long, tool string, url string, arg_url string, ok boolean, blocked boolean, error string, price_hints array<string>")
    noops = AU.noop_actions(AU.browser_actions(df), 16)
    got = {r.seq: (r.noop, r.streak, r.abandoned) for r in AU.noop_streaks(noops, block_rows=16).collect()}
    want, last, run = {}, {}, defaultdict(int)
    for s, _, sid, _, url, _, _, _, err, hints in rows:
        noop = sid in last and (err is not None or (url == last[sid][0] and set(hints) <= last[sid][1]))
        last[sid] = (url, set(hints))
        run[sid] = run[sid] + 1 if noop else 0
        want[s] = (noop, run[sid], run[sid] >= 2)
    assert got == want
    fired = {r.seq for r in AU.failure_streaks(df, block_rows=16).filter("fires").collect()}
    expect, run = set(), defaultdict(int)
    for s, _, sid, _, _, _, ok, _, err, _ in rows:
        run[sid] = run[sid] + 1 if (err or not ok) else 0
        if run[sid] == 3:
            expect.add(s)
            run[sid] = 0
    assert fired == expect


# --- guard ------------------------------------------------------------------------------------------

GUARD = "run_id long, session_id long, seq long, tool string, arg_url string, url string, error string, price_hints array<string>"


def verdicts(spark, rows, patterns=None):
    df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], GUARD)
    out = GD.guard_sessions(GD.attempts_with_facts(df, patterns)).orderBy("seq").collect()
    return [r.verdict for r in out]


def test_guard_gives_one_grace_after_noops(spark):
    page = ("browser_click", None, "http://h/a", None, [])
    search, root = "http://h/search?q=1", "http://h/"
    rows = [
        ("browser_open", "http://h/a", "http://h/a", None, []), page, page,  # two no-ops: given up
        page, ("browser_open", root, root, None, []),                        # refused: a home page is no recovery
        ("browser_open", search, search, None, []),                          # grace
        ("browser_click", None, search, None, []), ("browser_click", None, search, None, []),
        ("browser_open", "http://h/search?q=2", "http://h/search?q=2", None, []),
    ]
    assert verdicts(spark, rows) == ["run", "run", "run", "blocked_host", "blocked_host", "grace", "run", "run", "blocked_host"]


def test_guard_budget_survives_grace(spark):
    rows = [("browser_open", f"http://h/p{i}", f"http://h/p{i}", None, []) for i in range(8)]
    rows += [("browser_open", "http://h/search?q=1", "http://h/search?q=1", None, []), ("browser_click", None, "http://h/x", None, []), ("browser_open", "http://g/p", "http://g/p", None, [])]
    assert verdicts(spark, rows) == ["run"] * 8 + ["budget", "blocked_host", "run"]


def test_guard_refuses_known_root(spark):
    pats = spark.createDataFrame([("h.be", 0, ["q"], ["/s"])], "domain string, pos long, param_names array<string>, path_hints array<string>")
    rows = [("browser_open", "http://www.h.be/nl", "http://www.h.be/nl", None, []), ("browser_open", "http://h.be/nl?x=1", "http://h.be/nl?x=1", None, []), ("browser_open", "http://g.be/", "http://g.be/", None, [])]
    assert verdicts(spark, rows, pats) == ["blocked_root_open", "run", "run"]


# --- what was known at an event ---------------------------------------------------------------------


def plain_domain_matches(domain, stored):
    return domain if domain in stored else next((k for k in stored if domain.endswith("." + k)), None)


@pytest.mark.parametrize("block", [4, 1000])
def test_as_of_equals_plain_loop(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), s, "x") for s in rng.sample(range(150), 90)]
    versions = [(rng.choice("ab"), s, s * 10) for s in rng.sample(range(150), 40)]
    got = OR.as_of(spark.createDataFrame(rows, "k string, seq long, other string"), spark.createDataFrame(versions, "k string, seq long, v long"), ["k"], "seq", "v", block).collect()
    want = {(k, s): max(((t, v) for j, t, v in versions if j == k and t < s), default=(0, None))[1] for k, s, _ in rows}
    assert len(got) == len(rows) and {(r.k, r.seq): r.v for r in got} == want


@pytest.mark.parametrize("with_prior", [False, True])
def test_fetches_are_rerouted_by_what_was_known(spark, with_prior):
    rng = random.Random(8)
    hosts = ["a.com", "x.a.com", "b.com", "www.b.com", "y.b.com", "c.com"]
    events = []
    for s in range(160):
        tool = rng.choice(["web_fetch", "web_fetch", "browser_open"])
        bad = rng.random() < 0.15
        events.append((s, at(s), tool, f"https://{rng.choice(hosts)}/p{s}", not bad, bad, "403 Forbidden" if bad and rng.random() < 0.5 else None))
    prior = [("c.com", "web_fetch", "", at(0), 2, 0), ("b.com", "browser_open", "browser succeeded", at(0), 3, 1)] if with_prior else []
    df = spark.createDataFrame(events, "seq long, ts timestamp_ntz, tool string, url string, ok boolean, blocked boolean, error string")
    before = spark.createDataFrame(prior, "domain string, preferred_tool string, reason string, last_verified timestamp_ntz, success_count long, pos long")
    versions = TC.tactic_versions(df, before, block_rows=16)
    got = {r.seq: (r.rerouted, r.blocked) for r in TC.reroute_fetches_as_of(df, versions).collect()}
    counts = {r.seq: r.n for r in TC.with_tactic_as_of(df, versions).select("seq", F.col("tactic.success_count").alias("n")).collect()}
    stored = {d: [tool, n] for d, tool, _, _, n, _ in prior}
    rerouted, later = {}, set()
    for s, _, tool, url, ok, blocked, error in events:
        domain = url.split("/")[2].removeprefix("www.")
        key = plain_domain_matches(domain, stored)
        assert counts[s] == (stored[key][1] if key else None)
        if tool == "web_fetch":
            hit = key is not None and stored[key][0] == "browser_open"
            rerouted[s] = (hit, hit or blocked)
        fail = tool == "web_fetch" and (blocked or "403" in (error or ""))
        if fail or (tool == "browser_open" and ok and (blocked or stored.get(domain, [""])[0] == "browser_open")):
            stored[domain] = ["browser_open", stored.get(domain, ["", 0])[1] + 1]
    assert got == rerouted
    # The table learned from the whole log would reroute fetches that came before it was learned.
    final = {r.seq for r in TC.reroute_fetches(df, TC.learn_tactics(df, before)).filter("rerouted").collect()}
    assert final > {s for s, (hit, _) in rerouted.items() if hit}
    last = versions.groupBy("domain").agg(F.max_by("tactic", "seq").alias("t")).select("domain", "t.*")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in TC.learn_tactics(df, before).select(*last.columns).collect()}


def test_root_opens_are_rejected_by_patterns_known_then(spark):
    rng = random.Random(4)
    visits, opens, want, stored = [], [], {}, {}
    for s in range(240):
        host = rng.choice(["a.com", "m.a.com", "b.org"])
        if rng.random() < 0.6:
            path, names = f"/search/{rng.randrange(12 if host == 'a.com' else 4)}", rng.sample(["adults", "k1", "k2"], rng.randint(0, 2))
            url = f"https://{host}{path}" + ("?" + "&".join(f"{n}=1" for n in names) if names else "")
            visits.append((s, at(s), url, "browser_open", None, ["€ 1"]))
            params, paths = stored.setdefault(host, ([], []))
            params += [n for n in names if n not in params]
            if path not in paths:
                paths.insert(0, path)
                del paths[K.KEPT_PATHS :]
        else:
            opens.append((s, "browser_open", f"https://{host}/"))
            key = host if host in stored else next((k for k in stored if host.endswith("." + k) or k.endswith("." + host)), None)
            if key:
                want[s] = (key, stored[key][1][:5], stored[key][0][:15])
    versions = PT.pattern_versions(spark.createDataFrame(visits, "seq long, ts timestamp_ntz, url string, tool string, error string, price_hints array<string>"))
    got = PT.reject_root_opens_as_of(spark.createDataFrame(opens, "seq long, tool string, arg_url string"), versions, block_rows=16).collect()
    assert {r.seq: (r.pattern_key, r.learned_path_hints, r.learned_param_names) for r in got} == want
