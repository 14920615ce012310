import hashlib
import math
import re
from collections import Counter

import pytest

from spanlark.llm import pii
from tests.llm.conftest import SF

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    text, out, counts = text or "", [], []
    for k, (kind, rule) in enumerate(RULES.items()):
        n = 0
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            n += 1
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        counts.append(n)
    spans = [s for _, _, s in sorted(out)]
    return *counts, spans


TRICKY = [
    "a@b.c%d@e.f x@y..z me.@x-y.co.uk, a@b @c.d e@f.g.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3 9.1.1.1.", "4111 1111 1111 1111 4111-1111-1111-1112 0 00000000000000",
    "+1 (988) 555-2485 +12 +123456789012345678 ++49.30.1234567- +4 3", "é日本😀 x@y.zz 😀 10.0.0.1 😀 +49 30 1234567", "9" * 30000, "a" * 30000, "1 2 " * 9000, "a.b@" + "c." * 9000, "5.5" * 9000, "+" + "1(" * 5000,
]


def test_base_matches_python(spark, odd):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, tricky):
        got = pii.detect(docs).collect()
        want = Counter()
        for r in docs.collect():
            *n, spans = brute(r["text"])
            want[(r["doc_id"], *n, hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
        by = {r["doc_id"]: r for r in got}
        for r in docs.collect():
            assert {s for s in brute(r["text"])[-1]} <= set(by[r["doc_id"]]["spans"].split(",")) | {""}


def test_revealing_terms(spark):
    """A nickname that only occurs with one address reveals it; common words do not."""
    rows = [(i, f"the quick message number n{i} from zorblax at zor@mail.org today") for i in range(5)]
    rows += [(10 + i, f"the quick message number m{i} today") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in got[0]["spans"].split(",")
    assert got[0]["n_terms"] == 3  # zorblax, and "from" and "at", which this corpus has nowhere else
    assert "zorblax" not in got[0]["sanitised"] and "[email]" in got[0]["sanitised"] and "quick" in got[0]["sanitised"]
    assert all(got[10 + i]["spans"] == "" for i in range(200))


def test_entities_that_occur_once_and_twice_are_weighed(spark):
    """A nickname that is only where the address is reveals it, in one document or in two; a list of many is weighed at once."""
    rows = [(1, "the quick message from zorblax at zor@mail.org today"), (2, "the quick message from quillon at 10.1.2.3 today"), (3, "quillon and the message at 10.1.2.3")]
    rows += [(4, "the quick message today brindle " + " ".join(f"u{i}@h{i}.net" for i in range(3000)))]
    rows += [(10 + i, f"the quick message number m{i} from him and her at home today") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), evidence=1).collect()}
    for i, name in ((1, "zorblax"), (2, "quillon"), (3, "quillon"), (4, "brindle")):
        at = rows[i - 1][1].index(name)
        assert f"term:{at}:{at + len(name)}" in got[i]["spans"].split(",") and name not in got[i]["sanitised"]
        assert got[i]["n_terms"] == 1 and "message" in got[i]["sanitised"]
    assert all(got[10 + i]["spans"] == "" for i in range(200))


def test_production_evidence_is_two_different_lines(spark):
    """A word seen once with an address, or on copies of one line, is left; on two lines that differ it is revealing."""
    rows = [(1, "the quick message from zorblax at zor@mail.org today"), (2, "message from quillon at 10.1.2.3 today"), (3, "quillon and the message at 10.1.2.3")]
    rows += [(4 + i, "from brindle at b@c.net today\nthe quick message") for i in range(3)] + [(8, "wendeline\n10.1.2.3 today"), (9, "wendeline and\n10.1.2.3 message")]
    rows += [(10 + i, f"the quick message number m{i} from him and her at home today") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_terms"] == got[3]["n_terms"] == 1 and "quillon" not in got[2]["sanitised"]
    assert [got[i]["n_terms"] for i in (1, 4, 5, 6, 8, 9)] == [0] * 6  # wendeline is on no line of the address
    assert all(got[10 + i]["spans"] == "" for i in range(200))


def test_precision_and_recall_on_planted_names(spark):
    """Of 60 invented names, each in two to four documents beside its own address, all are marked; of the other words of real prose
    that stand on the same lines, or in documents without any address, hardly any."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    name = lambda k: f"qz{chr(97 + k % 26)}{chr(97 + k // 26)}vx"
    hosts = [text for _, text in docs if not brute(text)[-1]]  # a copy of a line with an address would be evidence of its own
    rows, planted = list(docs), {}
    for k in range(60):
        for j in range(2 + k % 3):
            i, text = 10**7 + k * 10 + j, hosts[(k * 7 + j * 211) % len(hosts)]
            first, *rest = text.split("\n")
            rows.append((i, "\n".join([f"{first} {'abcd'[j]} {name(k)} <{name(k)[:3]}{k}@host{k}.net>", *rest])))
            planted[i] = name(k)
    hits = chance = missed = clean = 0
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        marked = [text[int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind == "term"]
        hits += sum(m == planted.get(r["doc_id"]) for m in marked)
        chance += sum(m != planted.get(r["doc_id"]) for m in marked)
        missed += r["doc_id"] in planted and planted[r["doc_id"]] not in marked
        clean += r["doc_id"] not in planted and r["n_terms"] > 0
    assert missed == 0, (hits, chance, missed, clean)
    assert chance <= 0.05 * hits and clean <= 0.005 * len(docs), (hits, chance, missed, clean)


def test_revealing_terms_are_marked_in_documents_without_the_entity(spark):
    rows = [(i, f"the quick message from Zorblax at zor@mail.org today and number {i % 3}") for i in range(9)] + [(9, "zorblax was at home"), (10, "nothing here")]
    rows += [(20 + i, f"the quick message from somebody at home today and number {i % 3}") for i in range(400)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9]["spans"] == "term:0:7" and got[9]["n_email"] == 0 and got[9]["n_terms"] == 1 and "zorblax" not in got[9]["sanitised"]
    assert got[10]["spans"] == "" and got[10]["sanitised"] is None and len(got) == len(rows)


def brute_terms(rows, evidence, smooth=0.5, generalise=0.9):
    """Spans of revealing terms by plain counts over all rows."""
    total, term_rows, entity_rows, meetings = len(rows), {}, {}, {}
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t or "")]
    for n, (_, text) in enumerate(rows):
        for _, _, w in words(text):
            term_rows.setdefault(w, set()).add(n)
        for line in (text or "").split("\n"):
            own = {(s.split(":")[0], line[slice(*map(int, s.rsplit(":", 2)[1:]))].lower()) for s in brute(line)[-1]}
            for e in own:
                entity_rows.setdefault(e, set()).add(n)
                for w in {w for _, _, w in words(line)}:
                    meetings.setdefault((e, w), []).append((n, line))
    revealing = set()
    for (e, w), seen in meetings.items():
        rate = len(entity_rows[e]) / total
        if rate < 1 and len({line for _, line in seen}) >= evidence:
            given = (len({n for n, _ in seen}) + smooth * rate) / (len(term_rows[w]) + smooth)
            if math.log2(given / rate) / -math.log2(rate) >= generalise:
                revealing.add(w)
    out = Counter()
    for i, text in rows:
        base = [tuple(map(int, s.rsplit(":", 2)[1:])) for s in brute(text)[-1]]
        out[(i, sum(1 for a, b, w in words(text) if w in revealing and not any(c < b and a < d for c, d in base)))] += 1
    return out


@pytest.mark.parametrize("evidence", [1, 2])
def test_added_spans_match_brute_force(spark, evidence):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**7 + i, f"a line of {i % 4}\nask trellick at tr@mail.org or {i % 3}") for i in range(9)] + rows[:5]
    got = Counter((r["doc_id"], r["n_terms"]) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), evidence=evidence).collect())
    assert got == brute_terms(rows, evidence) and sum(n for _, n in got) > 0


def test_empty(empty):
    assert pii.detect(empty).count() == 0
