import hashlib
import random
import re

from maskwright.llm import decontam

DOCS = "doc_id long, text string, key string, words string, item_id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items):
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    marks = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontam.report(frame, marks).collect()), key=str), decontam.clean(frame, marks)


def case(seed, short):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "É", "é", "x1", "of", "a"] + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([10, 11, 14, 30])))) for i in range(12)]
    items += [(20, items[0][1]), (21, items[1][1].upper()), (0, items[0][1]), (None, " ".join(rng.choices(vocabulary, k=12))), (22, None), (23, " .,")]
    if short:
        items += [(30, "w1"), (31, "w2 é"), (32, "of a of a of"), (33, "the x1 w3 w4 w5 w6 w7 w8 w9"), (34, "zz")]
    docs = [(None, None, "k", "w", 1), (1, "", "k", "w", 1), (2, "...", "k", "w", 1), (3, "w1-w2 É", "k", "w", 1)]
    for i in range(40):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 9, 10, 40]))
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a : a + rng.choice([9, 10, 25])]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(w), "k", "w", i))
    docs += [docs[-1], (99, " ".join(["w1 the of"] * 9000 + [items[3][1]]), "k", "w", 1)]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = case(1, short=False)
    rows, clean = got(spark, docs, items)
    want = brute(docs, items)
    assert rows == want
    assert clean.columns == ["doc_id", "text", "key", "words", "item_id"]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_report_with_items_below_a_window(spark):
    docs, items = case(2, short=True)
    assert got(spark, docs, items)[0] == brute(docs, items)


def test_empty_tables(spark):
    docs, items = case(3, short=False)
    assert got(spark, docs[:6], [])[0] == brute(docs[:6], [])
    assert got(spark, [], items)[0] == []
