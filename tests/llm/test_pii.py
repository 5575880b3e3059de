import hashlib
import random
import re

from maskwright.llm import pii

DOCS = "doc_id long, text string, key string, spans string"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(FORMS).index(kind), m.end()))
    return sorted(out)


ODD = [
    None, "", "é a@b.c", "🙂 x.y@z-1.co.uk.", "a@b.c@d.e.f", "a@b.c-x@d.e", "@@a@b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 1.1.1.1",
    "00000000000000000000001.1.1.1", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "+1 (988) 555-2485.", "++1 2345678901", "+1 2 +123456789012345678", "+49 30 1234567 - 9", "a" * 5000 + "@", "1" * 20_000, "1." * 9000, "x@" * 4000, "a.b " * 20_000 + "q@r.st",
]


def test_forms_equal_brute_force(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(400):
        texts.append("".join(rng.choices(["1", "23", ".", "-", " ", "@", "+", "(", ")", "a", "é", "b.c", "4111111111111111", "127.0.0.1"], k=rng.randrange(40))))
    frame = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in frame.select("doc_id", pii.base_spans(frame.text).alias("base")).where("text is not null").collect()}
    for i, t in enumerate(texts):
        if t is not None:
            assert got[i] == brute(t), t[:200]


def bootstrap_corpus():
    rng = random.Random(6)
    prose = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = []
    for i in range(60):
        words = rng.choices(prose, k=40)
        at = rng.randrange(40)
        if i < 30:
            words[at:at] = ["reach", "me:", f"user{i}@mail.example.com,"]
        elif i < 34:
            words[at:at] = ["reach", "me:", f"user{i}(at)mail", "x"]
        elif i < 50:
            words[at:at] = [f"10.0.0.{i}"]
        docs.append((i, " ".join(words), "k", "s"))
    return [*docs, (100, None, "k", "s"), (None, "", "k", "s"), docs[31], (None, docs[31][1], "k", "s")]


def test_patterns_find_unseen_identifiers_and_nothing_else(spark):
    docs = bootstrap_corpus()
    rows = pii.find(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    by_text = {d[0]: d[1] for d in docs}
    for r in rows:
        base = [(s.start, s.kind, s.end) for s in r.base]
        more = [(s.start, s.kind, s.end) for s in r.spans if (s.start, s.kind, s.end) not in base]
        if r.doc_id is not None:
            assert base == brute(by_text[r.doc_id])
            unseen = re.search(r"user\d+\(at\)mail", by_text[r.doc_id] or "")
            assert more == ([(unseen.start(), 0, unseen.end())] if unseen else [])
    assert sum(len(r.spans) - len(r.base) for r in rows) == 6


def test_copies_of_a_text_do_not_hide_its_patterns(spark):
    docs = bootstrap_corpus()
    docs += [(1000 + i, docs[0][1], "k", "s") for i in range(1000)]
    rows = pii.find(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    assert sum(len(r.spans) - len(r.base) for r in rows) == 6


def test_masked_text_and_digest(spark):
    text = "mail a@b.cd or +1 (988) 555-2485, 4111 1111 1111 1111."
    frame = spark.createDataFrame([(1, text, "k", "s")], DOCS)
    row = frame.select(pii.masked(frame.text, pii.base_spans(frame.text)).alias("m"), pii.written(pii.base_spans(frame.text)).alias("w"), *pii.counts(pii.base_spans(frame.text))).first()
    assert row.m == "mail [EMAIL] or [PHONE], [CARD]."
    assert row.w == ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in brute(text))
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 1, 1)
    assert hashlib.sha256(row.w.encode()).hexdigest()


def test_no_rows(spark):
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0
