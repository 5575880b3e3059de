"""Analyses in a cache: what is read again, what a reviewer adds, and their JSON."""

import json

import pytest
from pyspark.sql import functions as F

from maskwright.plans import analysis as N

KEYS = ["doc", "page"]
SCHEMA = f"doc string, page int, lines {N.LINES}"


def line(n, text):
    x, boxes = 0, []
    for w in text.split():
        boxes.append((x, 20 * n, x + 8 * len(w), 20 * n + 10))
        x += 8 * len(w) + 8
    return (n, text.split(), boxes, (0, 20 * n, x - 8, 20 * n + 10))


def page(doc, number, *texts):
    return (doc, number, [line(n, t) for n, t in enumerate(texts)])


PAGES = [
    page("a", 1, "Name: Ann Berg,", "Mail ann@berg.example today"),
    page("a", 2, "nothing of interest"),
    page("b", 1, "Ann Berg writes to Tom", "Waldmann in Kiel"),
    page("c", 1),
]


class Finder:
    """Finds the words of a list by their text and notes which pages it was given."""

    def __init__(self, *known):
        self.known, self.seen = known, []

    def __call__(self, pages):
        self.seen.append(sorted(tuple(r) for r in pages.select(*KEYS).collect()))
        text = F.array_join(F.flatten(F.transform("lines", lambda x: x["words"])), " ")
        listed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("x").alias("owner"), F.lit(k).alias("type"), F.lit(t).alias("text")) for i, (k, t) in enumerate(self.known)])
        return pages.select(*KEYS, text.alias("__t"), F.inline(listed)).where(F.contains("__t", F.col("text"))).drop("__t")


def finder():
    return Finder(("person", "Ann Berg"), ("email", "ann@berg.example"), ("person", "Tom Waldmann"))


def rows(df):
    return {(r.doc, r.page): r for r in df.collect()}


def test_only_new_and_changed_pages_are_read(spark, tmp_path):
    cache, find = str(tmp_path / "cache"), finder()
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = rows(N.analysed(pages, KEYS, find, cache))
    assert find.seen == [[("a", 1), ("a", 2), ("b", 1), ("c", 1)]] and len(got) == 4
    assert [(v.pos, v.text) for v in got["a", 1]["values"]] == [(0, "Ann Berg"), (1, "ann@berg.example")]
    name, mail = got["a", 1].places
    assert (name.pos, name.place, name.printed, name.before, name.after, name.words, name.next_x) == (0, 0, "Ann Berg", "", ",", None, None)
    assert tuple(name.run_box) == (48, 0, 120, 10) and tuple(name.line_box) == (0, 0, 120, 10)
    assert (mail.pos, mail.how, mail.next_x) == (1, "exact", 176)
    upper, lower = [p for p in got["b", 1].places if p.pos == 2]
    assert (upper.printed, tuple(upper.words), lower.printed, tuple(lower.words)) == ("Tom", (0, 1), "Waldmann", (1, 2))
    assert got["a", 2]["values"] == got["c", 1].places == []
    # The second run reads no page; a changed page and a new one are read, other options read all.
    assert rows(N.analysed(pages, KEYS, find, cache)) == got and len(find.seen) == 1
    more = spark.createDataFrame([*PAGES[1:], page("a", 1, "Mail ann@berg.example"), page("d", 1, "Ann Berg")], SCHEMA)
    new = rows(N.analysed(more, KEYS, find, cache))
    assert find.seen[1:] == [[("a", 1), ("d", 1)]] and len(new) == 5
    assert [v.text for v in new["a", 1]["values"]] == ["ann@berg.example"] and new["a", 1].version == 2 and new["b", 1] == got["b", 1]
    N.analysed(pages.limit(0), KEYS, find, cache)
    assert len(find.seen) == 2
    N.analysed(pages, KEYS, find, cache, options="other rules")
    assert len(find.seen[2]) == 4


def test_accepted_values_locate_their_page_alone(spark, tmp_path):
    cache, find = str(tmp_path / "cache"), finder()
    pages = spark.createDataFrame(PAGES, SCHEMA)
    before = rows(N.analysed(pages, KEYS, find, cache))
    more = spark.createDataFrame(
        [("b", 1, "y", "city", "Kiel"), ("b", 1, "y", "city", "Kiel"), ("b", 1, "y", "id", "77 88"), ("b", 1, "x", "person", "Ann Berg"), ("z", 1, "y", "city", "Kiel"), ("a", 1, "y", "planet", "Mars"), ("a", 1, "y", "city", " ")],
        "doc string, page int, owner string, type string, text string",
    )
    told = {(r.doc, r.type, r.text): (r.located, r.error) for r in N.accept(pages, more, KEYS, cache).collect()}
    assert told == {
        ("b", "city", "Kiel"): (True, None), ("b", "id", "77 88"): (False, None), ("b", "person", "Ann Berg"): (True, None),
        ("z", "city", "Kiel"): (None, "page not analysed"), ("a", "planet", "Mars"): (None, "no type of values: planet"), ("a", "city", " "): (None, "no text"),
    }
    after = rows(N.analysed(pages, KEYS, find, cache))
    assert len(find.seen) == 1 and {k for k in after if after[k] != before[k]} == {("b", 1)}
    own, old = after["b", 1], before["b", 1]
    assert own.version == 2 and own["values"][: len(old["values"])] == old["values"] and own.places[: len(old.places)] == old.places
    assert [(v.pos, v.text) for v in own["values"]] == [(0, "Ann Berg"), (2, "Tom Waldmann"), (3, "Kiel"), (4, "77 88")]
    assert [(p.pos, tuple(p.run_box)) for p in own.places if p.pos > 2] == [(3, (96, 20, 128, 30))]
    # What is there already makes no new version.
    N.accept(pages, more, KEYS, cache)
    assert rows(N.analysed(pages, KEYS, find, cache)) == after


def test_rules_find_values(spark, tmp_path):
    pages = spark.createDataFrame([page("a", 1, "Mail ann@berg.example or", "ann@berg.example on 3.4.2021")], SCHEMA)
    got = N.analysed(pages, KEYS, N.by_rules(KEYS), str(tmp_path / "c")).first()
    assert sorted((v.type, v.text) for v in got["values"]) == [("date", "3.4.2021"), ("email", "ann@berg.example")]
    assert len([p for p in got.places if p.printed == "ann@berg.example"]) == 2


def test_json_round_trip_and_what_it_refuses(spark, tmp_path):
    got = N.analysed(spark.createDataFrame(PAGES, SCHEMA), KEYS, finder(), str(tmp_path / "cache"))
    told = got.withColumn("text", N.to_text(F.col("values"), F.col("places")))
    kept = {(r.doc, r.page): json.loads(r.text) for r in told.collect()}
    first = kept["a", 1]
    assert first["values"][0] == {"text": "Ann Berg", "type": "person", "owner": "x", "hint": None}
    assert first["located"][0][0]["run_box"] == [48, 0, 120, 10] and first["located"][0][0]["words"] is None
    # Positions are counted anew; all else comes back as it was.
    back = told.select(*KEYS, N.from_text(F.col("text")).alias("x"), "values", "places").where("page = 1 and doc = 'a'").first()
    assert back.x["values"] == back["values"] and back.x.places == back.places
    again = told.select(*KEYS, N.from_text(F.col("text")).alias("x")).select(*KEYS, N.to_text(F.col("x.values"), F.col("x.places")).alias("text"))
    assert {(r.doc, r.page): json.loads(r.text) for r in again.collect()} == kept
    assert spark.range(1).select(N.from_text(F.lit(None).cast("string")).alias("x")).first().x is None

    def spoiled(change):
        one = json.loads(json.dumps(first))
        change(one)
        return json.dumps(one)

    cases = {
        "malformed": ["[]", "{}", spoiled(lambda d: d.pop("located")), '{"values": [], "located": null}', "{", "x"],
        "for each value": [spoiled(lambda d: d["located"].pop())],
        "not a string": [spoiled(lambda d: d["values"][0].pop("type")), spoiled(lambda d: d["located"][0][0].update(how=None)), spoiled(lambda d: d["values"].__setitem__(0, None))],
        "not a box": [spoiled(lambda d: d["located"][0][0].update(run_box=[1, 2, 3])), spoiled(lambda d: d["values"][0].update(hint=[1, 2, 3, None])), spoiled(lambda d: d["located"][0][0].pop("line_box"))],
        "not a word span": [spoiled(lambda d: d["located"][0][0].update(words=[1]))],
        "": [spoiled(lambda d: d["located"][0][0].update(run_box=[1, 2, 3, "x"])), spoiled(lambda d: d["located"][0][0].update(next_x="far"))],
    }
    for error, texts in cases.items():
        for text in texts:
            with pytest.raises(Exception, match="(?s)" + (error if error != "malformed" else "malformed|MALFORMED")):
                spark.createDataFrame([(text,)], "t string").select(N.from_text(F.col("t"))).collect()
