"""op11: plain spans against the patterns themselves, disguised ones against what was disguised."""

import hashlib
import random
import re
import time

import pytest

from banditflow.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    atoms = ["a", "1", "2", "12", "255", "256", ".", ".", "@", "@", "-", "+", " ", "(", "é", "_", "+1", "4111111111111111",
             "x.y", "007", "🙂", "\n", "5555 4444"]
    for _ in range(30_000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 30)))
        assert [s[:3] for s in P.find_spans(text) if not s[3]] == base(text), text


@pytest.mark.parametrize("kind,words", [
    ("email", "jo.hn (at) example [dot] com"), ("email", "john dot doe at mail dot example dot com"), ("email", "n{at}h{dot}de"),
    ("email", "john @ example . org"), ("email", "user@example dot com"), ("email", "jane.46 at mail.example.com"),
    ("email", "jаne@exаmple.com"), ("email", "a​b@exa­mple.com"), ("email", "ｊａｎｅ＠example．com"),
    ("ip", "one nine two dot one six eight dot one dot double two"), ("ip", "１９２.168.0.１"), ("ip", "١٩٢.١٦٨.٠.١"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "4111\u00a01111\u00a01111\u00a01111"), ("card", "4111–1111–1111–1111"),
    ("phone", "plus one five five five one two three four five six seven"), ("phone", "+１ (743) 555‑3824"),
])
def test_disguised_spans_come_back_to_the_source(kind, words):
    for before, after in [("", ""), ("Éçß 🙂 call ​", " today.\n"), ("(", ") and x@y.com")]:
        text = f"{before}{words}{after}"
        spans = [s for s in P.find_spans(text) if s[3]]
        assert (kind, len(before), len(before) + len(words), True) in spans, (text, spans)
        assert [s[:3] for s in P.find_spans(text) if not s[3]] == base(text)


@pytest.mark.parametrize("text", [
    "Look at this point in time. We looked at example.com and at home.", "one, two, three and four things at nine",
    "Preis 3 € – 4 €, E=mc², 10 °C … “dot”", "one two three four five six", "m@n, at dot com", "Это обычный текст о том, что было.",
])
def test_ordinary_texts_stay_alone(text):
    assert P.find_spans(text) == []


def test_every_scan_is_linear():
    big = 400_000
    for unit in ["a", "1", "1 ", "@a", "+1((", "one ", " at", " ", "1.", "(", "a@", "dot ", "a at b dot ", "​"]:
        start = time.time()
        P.find_spans(unit * big)
        assert time.time() - start < 20, unit


def test_table_nulls_repeats_and_clashing_names(spark, nasty, nothing, texts):
    extra = [(90, "write to a (at) b (dot) org or c@d.org, +1 (743) 555-3824"), (90, "1.2.3.4"), (91, "x@y.z" * 50_000)]
    from tests.llm.conftest import SCHEMA, rows_of

    got = P.find_pii(spark.createDataFrame(rows_of(texts + extra), SCHEMA).repartition(3), keep=["doc_id", "text"])
    rows = P.pii_digest(got).collect()
    assert len(rows) == len(texts) + len(extra)
    for r in rows:
        want = base(r.text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in want) for k in P.KINDS]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in P.find_spans(r.text or ""))
    one = next(r for r in rows if r.doc_id == 90 and r.n_ip == 0)
    assert one.spans.startswith("email:9:27,email:31:38,phone:") and one.n_disguised == 1
    assert P.pii_digest(P.find_pii(nothing)).count() == 0
    assert set(P.find_pii(nasty).columns) == set(nasty.columns) | {"pii"}
