import hashlib
import itertools
import math
import random
import re
import time

import numpy as np

from cairnspark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_force(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"email": False, "ip": kind == "ip" and any(int(p) > 255 for p in m[0].split(".")), "card": not (16 <= len(digits) <= 19 and pii.luhn(digits)), "phone": not 8 <= len(digits) <= 15}[kind]
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


def test_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..--+(1234 5)%0²é") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute_force(text), text
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "1 " * 100_000, "@" * 100_000, "a@" * 50_000):
        pii.base_spans(text)  # linear, so this ends


def test_field_sums_and_best_labelling_are_exact():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(len(pii.KINDS), len(pii.FEATURES))))
    text = "x bob@site.org 10.0.0.1 4111 1111"
    tokens, found = pii.segments(text, 0, len(text))
    found = dict(list(found.items())[::3])
    scores, n = field.scores(found), len(tokens)
    arcs = [(i, j, k, s) for (i, j), row in scores.items() for k, s in enumerate(row) if s > -np.inf]

    def labellings(at=0):
        if at >= n:
            yield []
            return
        for rest in labellings(at + 1):
            yield rest
        for arc in arcs:
            if arc[0] == at:
                for rest in labellings(arc[1] + 1):
                    yield [arc, *rest]

    every = [(sum(a[3] for a in chosen), chosen) for chosen in labellings()]
    best = max(total for total, _ in every)
    assert math.isclose(sum(scores[i, j][k] for i, j, k in field.best(n, scores)), best, abs_tol=1e-9)
    z = math.log(sum(math.exp(t) for t, _ in every))
    total, marginal = field.expected(n, scores)
    assert math.isclose(total, z)
    for i, j, k, _ in arcs:
        assert math.isclose(marginal[i, j, k], sum(math.exp(t - z) for t, c in every if any(a[:3] == (i, j, k) for a in c)), abs_tol=1e-9)


def test_held_out_spans():
    field, hit, gold_n, got_n = pii.trained(), 0, 0, 0
    for text, gold in pii.examples(150, seed=1234):
        got = {(s, e, pii.KINDS.index(k)) for k, s, e in pii.added_spans(text, field, [])}
        hit, gold_n, got_n = hit + len(got & set(gold)), gold_n + len(gold), got_n + len(got)
    assert hit / gold_n > 0.95 and hit / got_n > 0.93


def test_islands_lose_no_candidate():
    """Every candidate of a whole text is one of an island, with local parts as long as a segment can hold."""
    rng = random.Random(6)
    for n in range(30, 48):
        for mail in (f"{'q' * n}@a.de", f"{'q' * n} [at] a.de", f"{'q' * (n - 9)}.{'z' * 8}@a.b.org", f"a@{'z' * (n - 8)}.{'y' * 5}"):
            text = f"{'word ' * rng.randint(0, 20)}{mail} {'x' * rng.randint(0, 60)} {'more ' * 15}{'r' * rng.randint(1, 90)}, 12"
            tokens, found = pii.segments(text, 0, len(text))
            got = set()
            for s, e in pii.islands(text):
                part, some = pii.segments(text, s, e)
                assert set(part) <= set(tokens)
                got |= {(part[i][0], part[j][1]) for i, j in some}
            assert got == {(tokens[i][0], tokens[j][1]) for i, j in found}, text
    pii.islands("a" * 300_000 + "1" + "b" * 300_000 + "1a" * 100_000)  # linear, so this ends


def test_query_columns(spark):
    text = "é bob@site.org and 10.0.0.1, bob (at) site (dot) org end"
    docs = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (None, "x", "c"), (1, text, "c")], "doc_id long, text string, spans string")
    out = pii.span_report(pii.find_pii(docs), pii.KINDS)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = out.collect()
    one = [r for r in rows if r["doc_id"] == 1]
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(brute_force(text), key=lambda x: (pii.KINDS.index(x[0]), x[1])))
    assert len(rows) == 5 and len(one) == 2 and one[0] == one[1]
    assert (one[0]["n_email"], one[0]["n_ip"], one[0]["base_sha256"]) == (1, 1, hashlib.sha256(base.encode()).hexdigest())
    start = text.index("bob (at)")
    assert one[0]["spans"].split(",") == [f"email:2:{2 + len('bob@site.org')}", f"email:{start}:{start + len('bob (at) site (dot) org')}", base.split(",")[1]]
    assert all(r["spans"] == "" and r["n_ip"] == 0 for r in rows if r["doc_id"] != 1)
    assert pii.find_pii(docs.where("false")).count() == 0
    assert list(itertools.islice(pii.islands("plain"), 1)) == []


def test_a_very_long_text_and_equal_scores(spark):
    text = "word " * 300_000 + "jo (at) mail (dot) com and a@b.de " + "x" * 200_000 + " 10.0.0.1"
    rows = pii.find_pii(spark.createDataFrame([(1, text), (2, text), (2, None)], "doc_id long, text string")).collect()
    found = [[(s["kind"], s["base"]) for s in r["spans"]] for r in rows]
    assert found[0] == found[1] == [("email", False), ("email", True), ("ip", True)] and found[2] == []
    flat = pii.Field(np.zeros_like(pii.trained().weights))  # every labelling scores the same: the one without entities is taken
    assert pii.added_spans("call 555-123-4567 now", flat, []) == []


def test_many_spans_take_linear_time():
    text = " ".join(f"u{k}@mail.com 10.0.{k % 200}.1 (at) " for k in range(4000))
    began = time.process_time()
    base = pii.base_spans(text)
    assert len(base) == 8000
    pii.added_spans(text, pii.trained(), base)
    assert time.process_time() - began < 60
