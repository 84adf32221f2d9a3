"""Queries against plain Python over whole tables, in which no row is left out."""

import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq

from corpusloom.functions.text import STOP_WORDS
from corpusloom.plans import registry

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(name, *columns, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def test_edge_precedence_counts_every_order(spark):
    kinds = {1: ("delegation", 5), 2: ("three_tier", 4), 3: ("family", 3)}
    found = defaultdict(Counter)
    for r in rows("lineitem", "l_suppkey", "l_partkey", "l_linenumber"):
        found[r["l_suppkey"] % 20, r["l_partkey"] % 20][kinds.get(r["l_linenumber"], ("citation", 0))] += 1
    want = set()
    for (s, t), counts in found.items():
        kind, order = max(counts, key=lambda k: k[1])
        want.add((s, t, kind, order or min(counts[kind, order], 60)))
    got = registry.queries()["edge_precedence"](spark, SF).collect()
    assert len(got) == len(want) and {(r["s"], r["t"], r["kind"], r["edge_weight"]) for r in got} == want


def planned():
    """Watermark, wanted tags and evaluated (item, created_at, deliver) of every subscriber."""
    events = rows("events", "event_id", "user_id", "event_type", "ts", sf=MORE)
    clock = datetime(2024, 1, 30, 18)
    queue = [(r["event_id"], r["ts"].replace(tzinfo=None), set() if r["event_id"] % 5 == 0 or r["event_id"] % 7 == 0 else {r["event_type"]}) for r in events]
    queue = [q for q in queue if clock - timedelta(hours=72) <= q[1] <= clock - timedelta(minutes=15)]
    out = {}
    for u in {r["user_id"] for r in events}:
        mark = None if u % 3 == 0 else datetime(2024, 1, 29) + timedelta(minutes=u)
        wanted = {0: set(), 1: {"click"}}.get(u % 4, {"view", "error"})
        after = mark or datetime(2024, 1, 30)
        out[u] = mark, [(item, at, not wanted or not tags or bool(wanted & tags)) for item, at, tags in queue if at > after]
    return out


def test_every_user_has_a_plan(spark):
    plans = planned()
    want = sorted((u, item, deliver) for u, (_, plan) in plans.items() for item, _, deliver in plan)
    assert sum(u >= 20 and len(plan) > 0 for u, (_, plan) in plans.items())
    got = registry.queries()["subscriber_plan"](spark, MORE).collect()
    assert sorted((r["subscriber"], r["item"], r["deliver"]) for r in got) == want


def test_every_user_has_a_watermark(spark):
    want = {u: (max((at for _, at, _ in plan), default=mark), sum(d for *_, d in plan)) for u, (mark, plan) in planned().items()}
    got = registry.queries()["watermark_advance"](spark, MORE).selectExpr("subscriber", "date_format(watermark, 'yyyy-MM-dd HH:mm:ss.SSSSSS') w", "delivered").collect()
    form = lambda at: at and at.strftime("%Y-%m-%d %H:%M:%S.%f")
    assert len(got) == len(want) and {r["subscriber"]: (r["w"], r["delivered"]) for r in got} == {u: (form(at), n) for u, (at, n) in want.items()}


def test_keyword_pairs_count_short_words(spark):
    words = {r["item_id"]: set(re.findall(r"[^\W_]{2,}", r["text"].lower())) - set(STOP_WORDS) for r in rows("benchmark", "item_id", "text")}
    want = {(a, b, len(words[a] & words[b])) for a in words for b in words if a < b and len(words[a] & words[b]) >= 3}
    got = registry.queries()["shared_keyword_pairs"](spark, SF).collect()
    assert {(r["a"], r["b"], r["shared"]) for r in got} == want and len(got) == len(want) > 0


def test_event_groups_on_pages(spark):
    """Page by page in plain Python, over all pages."""
    pages = rows("pages", "page_id", "url", "html")
    want, openers = {}, defaultdict(list)
    part = lambda html, tag: (re.search(f"(?s)<{tag}>(.*?)</{tag}>", html) or ["", ""])[1]
    pairs = lambda label: Counter(a + b for t in [re.sub(r"[\W_]", "", label.lower())] for a, b in zip(t, t[1:], strict=False))
    for r in sorted(pages, key=lambda r: r["page_id"]):
        own = {
            "id": r["page_id"], "label": part(r["html"], "h1") if r["page_id"] % 4 else "", "words": re.findall(r"[^\W_]{2,}", part(r["html"], "title").lower()),
            "tags": {r["page_id"] % 2} if r["page_id"] % 3 else set(),
        }
        for o in openers[re.match(r"https?://([^/]+)", r["url"])[1]]:
            if own["tags"] and o["tags"] and own["tags"] != o["tags"]:
                continue
            if own["label"].strip() and o["label"].strip():
                a, b = pairs(own["label"]), pairs(o["label"])
                like = sum((a & b).values()) >= 0.45 * min(sum(a.values()), sum(b.values())) and a and b
            else:
                n = sum(w in own["words"] for w in o["words"])
                like = n >= 2 and n >= 0.15 * max(len(own["words"]), len(o["words"]))
            if like:
                want[own["id"]] = o["id"]
                break
        else:
            want[own["id"]] = own["id"]
            openers[re.match(r"https?://([^/]+)", r["url"])[1]].append(own)
    got = {r["page_id"]: r["head_id"] for r in registry.queries()["event_groups"](spark, SF).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_trigram_search_on_conversations(spark):
    """The best extent by trying all of them, over whole texts."""
    def grams(text):
        return [f"  {w} "[i : i + 3] for w in re.findall(r"\w+", text.lower()) for i in range(len(w) + 1)]

    asked, found = set(grams("thonre attion")), []
    for r in rows("conversations", "conv_id", "turn", "text"):
        have, best = grams(r["text"]), 0.0
        spots = [i for i, g in enumerate(have) if g in asked]
        if len({have[i] for i in spots}) <= 0.12 * len(asked):
            continue
        for a in spots:
            inside = set()
            for g in have[a:]:
                inside.add(g)
                best = max(best, len(inside & asked) / (len(asked) + len(inside - asked)))
                if len(inside) > len(asked) / 0.12 + len(asked):
                    break
        if best > 0.12:
            found.append((-round(best, 9), r["conv_id"], r["turn"]))
    got = [(-round(r["sim"], 9), r["conv_id"], r["turn"]) for r in registry.queries()["trigram_search"](spark, SF).collect()]
    assert got == sorted(found)[:8] and got


def test_field_aggregate_on_conversations(spark):
    import json

    fields = {"law": (["tion"], ["ment"]), "market": (["ung"], ["der"]), "net": (["que"], [])}
    want = defaultdict(lambda: (Counter(), Counter()))
    for r in rows("conversations", "role", "text"):
        if r["text"] is None:
            continue
        scores = {f: sum(map(r["text"].count, strong)) + min(1.0, 0.5 * sum(map(r["text"].count, weak))) for f, (strong, weak) in fields.items()}
        best = max(scores.values())
        top = {f: s for f, s in scores.items() if s > 0 and s >= 0.8 * best} if best > 0 else {"other": 1.0}
        for f, s in top.items():
            want[r["role"]][0][f] += s / sum(top.values())
            want[r["role"]][1][f] += s / sum(top.values()) * len(r["text"])
    for r in registry.queries()["field_aggregate"](spark, SF).collect():
        for got, plain in zip((r["fields"], r["field_chars"]), want[r["role"]], strict=True):
            got = json.loads(got)
            assert got.keys() == plain.keys() and all(abs(got[f] - plain[f]) < 1e-3 for f in got)
