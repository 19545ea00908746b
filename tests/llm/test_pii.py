import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from derlem.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def force(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-_%+0125 ()é\U0001f600", max_size=60))
def test_base_spans_equal_the_formats(text):
    assert pii.base_spans(text) == force(text)


def test_more_base_spans():
    for text in ("a@b.c@d.e f@g a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (269) 555-3296 45", "x" * 200000 + "@y.z", "9" * 200000):
        assert pii.base_spans(text) == (force(text) if len(text) < 1000 else pii.base_spans(text))
    assert pii.base_spans("x" * 200000 + "@y.z") == [(0, 0, 200004)]


def test_words_beside_a_token_are_whole():
    ask = lambda before, after, reach=120: pii._context(before + "12345" + after, len(before), len(before) + 5, reach)
    assert ask("customer ref ", " for us") == ("ref", "customer ref", "for")
    assert ask("customer ref ", " for us", reach=6) == ("ref", "", "for")  # "er ref" begins within a word
    assert ask("customer ref ", " forty", reach=4) == ("ref", "", "")  # " for" ends within one
    assert ask("customer ref ", " for us", reach=3) == ("", "", "")
    assert ask("x" * 130 + " ", " " + "y" * 130) == ("", "", "")
    assert ask("x" * 130 + " ", " " + "y" * 130, reach=131) == ("x" * 130, "", "y" * 130)
    assert ask("", "") == ("", "", "")


def test_contexts_discover_identifiers(spark):
    r = random.Random(3)
    phone = lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    docs = [(i, f"word {r.choice(['and', 'the', 'of'])} hotline phone {phone()} and then the year {r.randrange(1000, 2030)}x{r.randrange(99)}") for i in range(40)]
    docs += [(100 + i, f"so hotline phone 0{r.randrange(200, 999)}-555-{r.randrange(1000, 9999)} for us") for i in range(5)]
    docs += [(200, "nothing but 12345-98 here"), (201, None), (202, ""), (None, "hotline phone 0312-555-9911 é"), (203, "hotline phone 0312-555-9911"), (203, "hotline phone 0312-555-9911")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_chars", F.length("text"))
    rows = pii.find(df).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    for i in range(100, 105):
        assert [s.kind for s in by_id[i].spans] == [3] and not by_id[i].base
    assert len(by_id[None].spans) == len(by_id[203].spans) == 1
    assert not by_id[200].spans and not by_id[201].spans and len(by_id[1].spans) == 1
    clean = {(r.doc_id, r.text) for r in pii.redact(df).collect()}
    assert (203, "hotline phone [PHONE]") in clean and (None, "hotline phone [PHONE] é") in clean and (201, None) in clean and (200, docs[45][1]) in clean
    assert pii.redact(df).count() == len(docs) and pii.redact(df).schema.names == df.schema.names
    assert pii.find(df.limit(0)).count() == 0


def test_accepted_identifiers_raise_new_patterns(spark):
    """Contexts of seeds reveal 30 identifiers; these alone make "ref" a pattern, which reveals one more."""
    docs = [(i, f"call hotline phone +1 (269) 555-{1000 + i}") for i in range(90)]
    docs += [(100 + i, f"call hotline phone 0312-777-{1000 + i}") for i in range(30)] + [(200 + i, f"customer ref 0312-777-{1000 + i}") for i in range(30)]
    docs += [(300, "customer ref 0312-888-1000")]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all([s.kind for s in rows[i].spans] == [3] and not rows[i].base for i in (100, 129, 200, 229, 300))
    once = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), pii.Bootstrap(rounds=1)).where("doc_id = 300").first()
    assert not once.spans  # a second step


def test_query_against_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    name = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted((i, *(sum(k == n for _, k, _ in force(t or "")) for n in range(4)), hashlib.sha256(name(force(t or "")).encode()).hexdigest()) for i, t in docs)
    got = pii.op2_pii_bootstrap(spark, sf).collect()
    assert sorted(tuple(r)[:-1] for r in got) == want
    texts = dict(docs)
    assert all(set(name(force(texts[r.doc_id] or "")).split(",")) <= set(r.spans.split(",")) for r in got)


def bootstrap_by_force(docs, at):
    """(doc_id, start, end, kind) of discovered spans, by plain loops over dictionaries."""
    seen, places = [], {}
    for i, text in docs:
        text = text or ""
        base = pii.base_spans(text)
        for kind, a, b in [(k, a, b) for a, k, b in base] + [(-1, a, b) for a, b in pii.candidates(text, base)]:
            left, after = re.findall(r"\w+", text[max(0, a - 120) : a]), re.findall(r"\w+", text[b : b + 120])
            sides = {"l1": left[-1] if left else "", "l2": " ".join(left[-2:]) if len(left) > 1 else "", "r1": after[0] if after else ""}
            seen.append((i, a, b, kind, text[a:b].lower(), {(side, w.lower()) for side, w in sides.items() if w}))
        said = [w for w in re.split(r"\W+", text.lower()) if w]
        for k, w in enumerate(said):
            for words in {w, " ".join(said[max(0, k - 1) : k + 1])}:
                places[words] = places.get(words, 0) + 1
    used, members, kinds = {}, {}, {}
    for _, _, _, kind, value, patterns in seen:
        for p in patterns:
            used[p] = used.get(p, 0) + 1
            members.setdefault(p, {})[value] = max(kind, members.get(p, {}).get(value, -1))
    members = {p: m for p, m in members.items() if used[p] >= at.share * places.get(p[1], float("inf"))}
    seeds = {(v, k): 1.0 for m in members.values() for v, k in m.items() if k >= 0}
    score = dict(seeds)
    for _ in range(at.rounds):
        trust = {}
        for p, m in members.items():
            for kind in range(4):
                good = sum(x for (v, k), x in score.items() if k == kind and v in m)
                if good >= at.support and good / (len(m) + 1) >= at.precision:
                    trust[p, kind] = good / (len(m) + 1)
        gained = {}
        for (p, kind), x in trust.items():
            for v, k in members[p].items():
                if k < 0:
                    gained[v, kind] = gained.get((v, kind), 1.0) * (1 - x)
        score = dict(seeds)
        for key, miss in gained.items():
            score[key] = max(score.get(key, 0.0), 1 - miss)
    best = {}
    for (v, kind), x in score.items():
        if x >= at.accept:
            best[v] = max(best.get(v, (0, 0)), (x, -kind))
    return sorted((i, a, b, -best[v][1]) for i, a, b, kind, v, _ in seen if kind < 0 and v in best)


def test_bootstrap_against_force(spark):
    r = random.Random(11)
    ids = [f"{r.choice('AB')}{r.randrange(10, 99)}-{r.randrange(1000, 9999)}" for _ in range(160)]
    seed = [lambda: f"+1 (269) 555-{r.randrange(1000, 9999)}", lambda: f"user{r.randrange(99)}@mail{r.randrange(9)}.example.com", lambda: f"10.{r.randrange(255)}.{r.randrange(255)}.7"]
    contexts = [("hotline phone", 0), ("write mail", 1), ("server node", 2), ("badge serial", None), ("order no", None), ("case ref", None)]
    docs = []
    for i in range(500):
        words = []
        for _ in range(r.randrange(1, 5)):
            (name, kind) = r.choice(contexts)
            own = kind is not None and r.random() < 0.9
            words += ["so", r.choice(["we", "they"]), *name.split(), seed[kind]() if own else r.choice(ids[:40] if name in ("badge serial", "hotline phone") else ids), r.choice(["and", "for", "now"])]
        docs.append((i, " ".join(words)))
    for at in (pii.Bootstrap(), pii.Bootstrap(rounds=1, precision=0.5, accept=0.5), pii.Bootstrap(rounds=4, precision=0.4, accept=0.4, share=0.1)):
        want = bootstrap_by_force(docs, at)
        base = {i: set(pii.base_spans(t)) for i, t in docs}
        rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), at).collect()
        got = sorted((x.doc_id, s.start, s.end, s.kind) for x in rows for s in x.spans if (s.start, s.kind, s.end) not in base[x.doc_id])
        assert got == want
    assert want
