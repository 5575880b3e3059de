"""All queries of the de-identification operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import arrays as A
from maskwright.functions import barcode, dates
from maskwright.functions import boxes as B
from maskwright.functions import text as T
from maskwright.operators import candidates as C
from maskwright.operators import leak, location, matching, measures, pixels, reading, replace, values, votes
from maskwright.plans import analysis, copies, finished, report
from maskwright.plans.deidentify import deidentified
from maskwright.sources import pages as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by its key to four tasks a core; a file of few bytes comes in one split, whatever is made of its rows."""
    return table(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism, key)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentified(table(spark, sf_dir, "documents").select("doc_id", "text"))


# SQL for the normal form; upper() of the engine keeps ß, so it is written out first.
_NORM = "regexp_replace(upper(replace({0}, 'ß', 'SS')), '[^0-9A-ZÄÖÜß]', '', 'g')"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_HASH = "CAST(('0x' || substr(md5(concat_ws(chr(31), {0})), 1, 8)) AS BIGINT)"
_TOKENS = "SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))


# -- candidates -----------------------------------------------------------------------------------


@query("""
WITH m AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS text FROM documents
) SELECT doc_id, text, count(*) AS n FROM m GROUP BY ALL
""")
def candidate_emails(spark, sf_dir):
    """E-mail candidates with their counts, from the recognizers' spans."""
    spans = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(C.recognized(F.col("text"), ["EMAIL_ADDRESS"])).alias("s"))
    found = spans.select("doc_id", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"))
    return found.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (
  SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS v, 'EMAIL_ADDRESS' AS entity FROM documents
), p AS (
  SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(text, '\\+[0-9][ ().0-9-]{7,20}[0-9]')) AS v, 'PHONE_NUMBER' AS entity FROM documents
) SELECT lang, entity, count(*) AS n FROM (
  SELECT * FROM e UNION ALL SELECT * FROM p WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 10 AND 15
) GROUP BY ALL
""")
def candidates_by_language(spark, sf_dir):
    """Distinct e-mail and phone candidates of each document, by language."""
    docs = table(spark, sf_dir, "documents")
    found = C.find(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"], wanted=["EMAIL_ADDRESS", "PHONE_NUMBER"])
    return found.groupBy("lang", "entity").agg(F.count(F.lit(1)).alias("n"))


_FOUND_SQL = """
WITH f AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS text FROM documents
), v AS (
  SELECT f.doc_id, split_part(f.text, '@', 1) AS text FROM f JOIN labels USING (doc_id) WHERE quality = 1
) SELECT doc_id, text FROM f WHERE {0} EXISTS (
  SELECT 1 FROM v WHERE v.doc_id = f.doc_id AND contains(upper(regexp_replace(f.text, '[^0-9A-Za-z]', '', 'g')), upper(regexp_replace(v.text, '[^0-9A-Za-z]', '', 'g'))))
"""


def _covering(spark, sf_dir, join):
    found = C.find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], wanted=["EMAIL_ADDRESS"])
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    known = found.join(good, "doc_id").select("doc_id", F.substring_index("text", "@", 1).alias("text"))
    return join(found, known, ["doc_id"]).select("doc_id", "text")


@query(_FOUND_SQL.format("NOT"))
def candidates_unconfirmed(spark, sf_dir):
    return _covering(spark, sf_dir, C.unconfirmed)


@query(_FOUND_SQL.format(""))
def candidates_confirmed(spark, sf_dir):
    return _covering(spark, sf_dir, C.confirmed)


# -- text functions -------------------------------------------------------------------------------


@query(f"SELECT {_NORM.format('w')} AS norm, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL")
def normal_forms(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(T.norm(F.col("w")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT doc_id, w, {_DIGITS.format('w')} AS digits,
  regexp_replace(CASE WHEN regexp_matches(w, '[0-9]') THEN translate(w, 'OoIlZzSBG', '001122586') ELSE w END, '[^0-9]', '', 'g') AS folded, count(*) AS n
FROM ({_TOKENS}) WHERE regexp_matches(w, '[0-9]') GROUP BY ALL
""")
def folded_digits(spark, sf_dir):
    own = _tokens(spark, sf_dir).where(F.col("w").rlike("[0-9]"))
    own = own.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return own.select("doc_id", "w", T.digits(F.col("w")).alias("digits"), T.folded_digits(F.col("w")).alias("folded"), "n")


_MONEY = "replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.')"


@query(f"""
SELECT o_orderkey, {_MONEY} || ' EUR' AS amount, true AS with_unit, true AS bare, false AS key_only FROM orders
""")
def amounts(spark, sf_dir):
    """Prices in German form are amounts, with a unit and without; order numbers aren't."""
    money = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    unit = F.concat(money, F.lit(" EUR"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", unit.alias("amount"), money.alias("m"))
    return own.select(
        "o_orderkey", "amount", T.is_amount(F.col("amount")).alias("with_unit"), T.is_amount(F.col("m")).alias("bare"), T.is_amount(F.col("o_orderkey").cast("string")).alias("key_only")
    )


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{16}\\b')) AS number FROM documents),
c AS (SELECT doc_id, number, list_sum([CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(number[i] AS INT) > 9 THEN 2 * CAST(number[i] AS INT) - 9 ELSE 2 * CAST(number[i] AS INT) END
  ELSE CAST(number[i] AS INT) END FOR i IN range(1, 17)]) AS total FROM m)
SELECT doc_id, number, total % 10 = 0 AS valid, count(*) AS n FROM c GROUP BY ALL
""")
def card_checks(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{16}\b"), F.lit(0))).alias("number"))
    return found.groupBy("doc_id", "number", T.luhn_ok(F.col("number")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, 'DE' || lpad(CAST(98 - CAST(lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0')
  || lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS iban FROM customer
""")
def iban_checks(spark, sf_dir):
    bban = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DE"), T.iban_check(F.lit("DE"), bban), bban).alias("iban"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS shape,
  length(p_name || ' ' || p_brand) AS n FROM part
""")
def same_shapes(spark, sf_dir):
    """The layout of invented codes is the layout of the old."""
    old = F.concat_ws(" ", "p_name", "p_brand")
    own = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", T.same_shape(old, F.col("p_partkey")).alias("new"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("new", "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return own.select("p_partkey", shape.alias("shape"), F.length("new").cast("long").alias("n"))


@query("""
SELECT doc_id, list_sort(list_distinct(list_filter(list_concat(
    [regexp_replace(upper(replace(w, 'ß', 'SS')), '[^0-9A-ZÄÖÜß]', '', 'g')],
    list_transform(regexp_extract_all(w, '[A-Za-zÄÖÜäöüß]{4,}'), lambda x: regexp_replace(upper(replace(x, 'ß', 'SS')), '[^0-9A-ZÄÖÜß]', '', 'g')),
    regexp_extract_all(regexp_replace(w, '[.\\- ]', '', 'g'), '[0-9]{4,}')), lambda p: length(p) >= 4))) AS pieces
FROM (SELECT doc_id, text AS w FROM documents)
""")
def leak_pieces(spark, sf_dir):
    """The pieces of whole texts, taken for names."""
    return table(spark, sf_dir, "documents").select("doc_id", T.pieces(F.col("text"), F.lit("person")).alias("pieces"))


@query(_SQL["leak_pieces"])
def leak_pieces_of_texts(spark, sf_dir):
    return leak_pieces(spark, sf_dir)


@query("""
WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '1') AS a, lpad(CAST(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE 1 END AS VARCHAR), 8, '1') AS b FROM orders)
SELECT o_orderkey, levenshtein(a, b) <= 1 AS slip FROM k
""")
def one_slips(spark, sf_dir):
    key = F.col("o_orderkey")
    other = key + F.when(key % 3 == 0, 11).otherwise(1)
    padded = lambda c: F.lpad(c.cast("string"), 8, "1")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.one_slip(padded(key), padded(other)).alias("slip"))


# -- dates ----------------------------------------------------------------------------------------

# English month names; May is short in all styles that share it, so what comes after it is short as well.
_EN = "['January','February','March','April','May','June','July','August','September','October','November','December']"

_STYLE = "CASE WHEN month({0}) = 5 THEN substr({1}, 1, 3) ELSE {1} END"


@query(f"""
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 DAY, '%d.%m.%Y') AS dot, strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') AS iso,
  strftime(o_orderdate + INTERVAL 20 DAY, '%d/%m/%y') AS slash,
  CASE WHEN day(o_orderdate) >= 10 THEN strftime(o_orderdate + INTERVAL 20 DAY, '%d') ELSE CAST(day(o_orderdate + INTERVAL 20 DAY) AS VARCHAR) END || ' ' || {_STYLE.format('o_orderdate', _EN + '[month(o_orderdate + INTERVAL 20 DAY)]')} || ' ' || CAST(year(o_orderdate + INTERVAL 20 DAY) AS VARCHAR) AS named
FROM orders
""")
def dates_shifted(spark, sf_dir):
    """Dates in four written forms, moved as text; the SQL moves the dates themselves."""
    d = F.col("o_orderdate")
    own = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(d, "dd.MM.yyyy").alias("dot"),
        F.date_format(d, "yyyy-MM-dd").alias("iso"),
        # Two-digit years are of this century; the SQL prints two digits as well.
        F.date_format(d, "dd/MM/yy").alias("slash"),
        F.date_format(d, "d MMMM yyyy").alias("named"),
    )
    return own.select("o_orderkey", *[dates.shift(F.col(c), 20).alias(c) for c in ("dot", "iso", "slash", "named")])


@query(f"""
SELECT l_orderkey, l_linenumber, {_STYLE.format('l_shipdate', _EN + "[month(date_trunc('month', l_shipdate) + INTERVAL 2 MONTH)]")} || ' ' || CAST(year(date_trunc('month', l_shipdate) + INTERVAL 2 MONTH) AS VARCHAR) AS shipped FROM lineitem
""")
def months_shifted(spark, sf_dir):
    written = F.date_format("l_shipdate", "MMMM yyyy")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.shift(written, 60).alias("shipped"))


@query("""
SELECT event_id, strftime(ts - INTERVAL 95 MINUTE, '%H:%M:%S') AS moved FROM events
""")
def times_shifted(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.shift_times(F.date_format("ts", "HH:mm:ss"), -95).alias("moved"))


# -- replacement and leaks ------------------------------------------------------------------------

_POOLS = {
    "first": str(list(replace.FIRST)),
    "last": str(list(replace.LAST)),
}


@query(f"""
WITH o AS (SELECT c_nationkey AS doc, c_custkey AS pos, c_mktsegment AS owner, c_name AS text FROM customer),
r AS (SELECT doc, owner, row_number() OVER (PARTITION BY doc ORDER BY min(pos)) - 1 AS rank FROM o GROUP BY doc, owner),
s AS (SELECT unnest([1, 2]) AS seed),
i AS (SELECT doc, seed, owner, {_POOLS['first']}[{_HASH.format("doc, seed, owner, 'first'")} % 12 + 1] || ' ' || {_POOLS['last']}[({_HASH.format("doc, seed, 'last'")} + rank) % 10 + 1] AS name FROM r, s)
SELECT o.doc, o.pos, seed, i.owner, name AS new FROM o JOIN i USING (doc, owner)
""")
def replacements(spark, sf_dir):
    """Two copies of customers' names, one owner for each market segment of a nation."""
    own = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc"), F.lit(0).alias("page"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("owner"), F.lit("person").alias("type"), F.concat(F.lit("Mr "), "c_name").alias("text")
    )
    copies = spark.range(1, 3).select(F.col("id").cast("int").alias("seed"))
    return replace.changes(own, copies, ["doc"]).select("doc", "pos", "seed", "owner", "new")


@query(f"""
WITH v AS (SELECT DISTINCT doc_id, {_NORM.format('w')} AS piece FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS w FROM documents))
SELECT v.doc_id, list_sort(list(piece)) AS pieces FROM v JOIN (SELECT doc_id, {_NORM.format('text')} AS page FROM documents) p USING (doc_id) WHERE contains(page, piece) GROUP BY v.doc_id
""")
def leaks_of_words(spark, sf_dir):
    """All long words of every text, searched for on its own page."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", "text", F.lit("").alias("context"))
    words = docs.select("doc_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)))).alias("text")).where("text is not null")
    found = leak.leaks(pages, words.select("doc_id", F.lit("person").alias("type"), "text"), ["doc_id"])
    return found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pieces")))).alias("pieces"))


@query()
def leaks_of_values(spark, sf_dir):
    """All values that are recognized in a document, searched for in its de-identified text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = C.find(docs, ["doc_id"]).select("doc_id", C.value_type(F.col("entity")).alias("type"), "text")
    pages = flagship(spark, sf_dir).select("doc_id", "text", F.lit("").alias("context"))
    return leak.leaks(pages, old, ["doc_id"])


@query()
def deidentified_documents(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS v FROM documents)
SELECT d.doc_id, coalesce(bool_or(contains(d.text, v)), false) AS had, false AS has FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
""")
def emails_gone(spark, sf_dir):
    """Whether a text had e-mail addresses, and whether one of them is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    new = flagship(spark, sf_dir).select("doc_id", "text")
    mails = F.regexp_extract_all("old", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))
    both = docs.join(new, "doc_id").withColumn("mails", mails)
    return both.select("doc_id", (F.size("mails") > 0).alias("had"), F.exists("mails", lambda m: F.contains("text", m)).alias("has"))


# -- values and matching --------------------------------------------------------------------------


@query("""
SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS some, 1 AS n FROM events
""")
def json_salvage(spark, sf_dir):
    """Objects out of answers that are cut off after the first."""
    cut_off = F.concat(F.lit("[ "), "props", F.lit(', {"cut'))
    own = table(spark, sf_dir, "events").select("event_id", values.json_objects(cut_off).alias("o"))
    return own.select("event_id", (F.length(F.get("o", F.lit(0))) > 2).alias("some"), F.size("o").alias("n"))


@query("""
SELECT o_orderkey, unnest(['id', 'date', 'time']) AS type, unnest([CAST(o_orderkey + 100 AS VARCHAR), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%H:%M')]) AS text FROM orders
""")
def compound_values(spark, sf_dir):
    line = F.concat_ws(" ", (F.col("o_orderkey") + 100).cast("string"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "HH:mm"), F.lit("A1"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("pos"), line.alias("text"), F.lit("id").alias("type"))
    return values.normalise(own, ["o_orderkey"]).select("o_orderkey", "type", "text")


@query()
def values_in_lines(spark, sf_dir):
    """Every value that is recognized in a document, found in all of its lines by similarity."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.select("doc_id", "line", F.filter(F.split("t", r"\s+"), lambda w: w != "").alias("words"))
    wanted = C.find(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", F.col("text").alias("value")).distinct()
    found = matching.find_all(wanted, lines, ["doc_id"])
    return found.withColumn("score", F.round("score", 9))


# -- arrays, boxes, barcodes ----------------------------------------------------------------------

_FLAGS = "SELECT vec_id, unnest(embedding) > 0 AS f, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query(f"""
WITH t AS (SELECT vec_id, i, lag(i) OVER w AS p FROM ({_FLAGS}) WHERE f WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p - 1 >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM t)
SELECT vec_id, CAST(min(i) AS INT) AS start, CAST(max(i) + 1 AS INT) AS "end" FROM g GROUP BY vec_id, b
""")
def bands(spark, sf_dir):
    flags = F.transform("embedding", lambda x: x > 0)
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(A.bands(flags, 2)).alias("b"))
    return own.select("vec_id", "b.start", "b.end")


@query(f"""
WITH g AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM ({_FLAGS}) WHERE f),
r AS (SELECT vec_id, k, count(*) AS n FROM g GROUP BY ALL)
SELECT e.vec_id, CAST(coalesce(max(n), 0) AS INT) AS longest, CAST(coalesce(2 * count(n) - 1, 0) AS INT) AS n_runs FROM embeddings e LEFT JOIN r USING (vec_id) GROUP BY e.vec_id
""")
def flag_runs(spark, sf_dir):
    flags = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", A.longest_true_run(flags).alias("longest"), F.size(A.runs(flags)).alias("n_runs"))


@query("""
WITH g AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(floor(abs(x) * 100) AS INT))) AS v FROM embeddings)
SELECT vec_id, v[least(len(v), CAST(floor(0.9 * len(v)) AS INT) + 1)] AS paper, v[len(v) // 2 + 1] AS upper_median,
  greatest(4, CAST(floor(median_of) AS INT)) AS line_height
FROM (SELECT *, list_median(list_filter(v, lambda x: x > 0)) AS median_of FROM (SELECT *, NULL AS z FROM g))
""".replace("list_median(list_filter(v, lambda x: x > 0))", "list_aggregate(list_filter(v, lambda x: x > 0), 'median')"))
def order_statistics(spark, sf_dir):
    grays = F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(100).cast("float")).cast("int"))
    own = table(spark, sf_dir, "embeddings").select("vec_id", grays.alias("g"))
    return own.select("vec_id", A.paper_level(F.col("g")).alias("paper"), A.upper_median(F.col("g")).alias("upper_median"), A.line_height(F.col("g")).alias("line_height"))


def _part_boxes(spark, sf_dir):
    key = F.col("p_partkey")
    x, y = key * 37 % 210, key * 53 % 290
    return table(spark, sf_dir, "part").select((key % 20).alias("page"), key.alias("id"), B.box(x, y, x + 20 + F.col("p_size"), y + 12).alias("box"))


_BOXES = "SELECT p_partkey % 20 AS page, p_partkey AS id, p_partkey * 37 % 210 AS x0, p_partkey * 53 % 290 AS y0, p_partkey * 37 % 210 + 20 + p_size AS x1, p_partkey * 53 % 290 + 12 AS y1 FROM part"


@query(f"""
WITH b AS ({_BOXES}), j AS (
  SELECT a.page, a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h,
    least((a.x1 - a.x0) * 12, (b.x1 - b.x0) * 12) AS smaller
  FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b FROM j WHERE w > 0 AND h > 0 AND w * h >= 0.3 * smaller
""")
def overlapping_boxes(spark, sf_dir):
    return location.overlapping_pairs(_part_boxes(spark, sf_dir), ["page"])


@query(f"""
WITH b AS ({_BOXES})
SELECT u.page, u.id AS upper, l.id AS lower FROM b u JOIN b l ON u.page = l.page AND u.id < l.id
WHERE l.y0 - u.y1 BETWEEN -6 AND 12 AND l.x0 < u.x1 AND u.x0 < l.x1
""")
def next_lines(spark, sf_dir):
    lines = _part_boxes(spark, sf_dir).withColumnRenamed("id", "line")
    return location.next_lines(lines, ["page"], 12)


@query(f"""
WITH b AS ({_BOXES}), d AS (
  SELECT v.page, v.id AS value, b.id AS line, row_number() OVER (PARTITION BY v.page, v.id
    ORDER BY sqrt(((v.x0 + v.x1) / 2.0 - (b.x0 + b.x1) / 2.0) ** 2 + ((v.y0 + v.y1) / 2.0 - (b.y0 + b.y1) / 2.0) ** 2), b.id) AS rank
  FROM b v JOIN b ON v.page = b.page)
SELECT page, value, line, rank FROM d WHERE rank <= 12
""")
def nearest_lines(spark, sf_dir):
    """The nearest lines of every box."""
    boxes = _part_boxes(spark, sf_dir)
    hints = boxes.select("page", F.col("id").alias("value"), F.col("box").alias("hint"))
    found = location.nearest_lines(hints, boxes.withColumnRenamed("id", "line"), ["page"])
    return found.select("page", "value", "line", F.col("rank").cast("long").alias("rank"))


@query(_SQL["nearest_lines"])
def nearest_lines_of_boxes(spark, sf_dir):
    return nearest_lines(spark, sf_dir)


@query("""
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS n FROM orders),
s AS (SELECT o_orderkey, [105] || list_transform([1, 3, 5, 7], lambda i: CAST(n[i : i + 1] AS INT)) AS b FROM d)
SELECT o_orderkey, b || [CAST((105 + b[2] + 2 * b[3] + 3 * b[4] + 4 * b[5]) % 103 AS INT)] AS symbols, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS back FROM s
""")
def barcodes(spark, sf_dir):
    number = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    own = dealt(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", barcode.symbols(number).alias("symbols"), barcode.widths(number).alias("w"))
    return own.select("o_orderkey", "symbols", barcode.decode(F.col("w")).alias("back"))


# Pages of one line each, drawn from the sizes of parts.
_LINE = "5 + p_partkey % 20"


@query(f"""
SELECT p_partkey AS page, CAST({_LINE} AS INT) AS x0, 10 AS y0, CAST({_LINE} + 20 + p_size AS INT) AS x1, 18 AS y1 FROM part
""")
def ink_lines(spark, sf_dir):
    """The text lines of drawn pages, found by their ink."""
    x0 = F.lit(5) + F.col("p_partkey") % 20
    x1 = x0 + 20 + F.col("p_size")
    line = F.concat(F.repeat(F.lit("F0"), x0.cast("int")), F.repeat(F.lit("00"), (x1 - x0).cast("int")), F.repeat(F.lit("F0"), (200 - x1).cast("int")))
    gray = F.unhex(F.concat(F.repeat(F.lit("F0"), F.lit(10 * 200)), F.repeat(line, F.lit(8)), F.repeat(F.lit("F0"), F.lit(12 * 200))))
    pages = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("page"), F.lit(200).alias("width"), F.lit(30).alias("height"), gray.alias("gray"))
    return pixels.ink_lines(pages, ["page"])


@query(f"""
WITH o AS (SELECT c_nationkey AS doc, c_custkey AS pos, c_mktsegment AS owner, c_name AS text FROM customer),
r AS (SELECT doc, owner, row_number() OVER (PARTITION BY doc ORDER BY min(pos)) - 1 AS rank FROM o GROUP BY doc, owner),
s AS (SELECT unnest([5, 6, 7]) AS seed),
i AS (SELECT doc, seed, owner, {_POOLS['first']}[{_HASH.format("doc, seed, owner, 'first'")} % 12 + 1] || ' ' || {_POOLS['last']}[({_HASH.format("doc, seed, 'last'")} + rank) % 10 + 1] AS name FROM r, s)
SELECT o.doc, o.pos, seed, i.owner, name AS new, o.pos % 3 > 0 AS located, CAST(o.pos % 3 AS BIGINT) AS n_places FROM o JOIN i USING (doc, owner)
""")
def copy_keys(spark, sf_dir):
    """The public keys of three copies of customers' names, each printed at up to two places."""
    own = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc"), F.lit(0).alias("page"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("owner"), F.lit("person").alias("type"), F.concat(F.lit("Mr "), "c_name").alias("text")
    )
    many = F.when(F.col("pos") % 3 > 0, F.sequence(F.lit(1), (F.col("pos") % 3).cast("int")))
    places = own.select("doc", "page", "pos", F.explode(many).alias("place"), F.lit("ocr").alias("how"), F.col("text").alias("printed"), F.lit(None).cast("int").alias("words"))
    return copies.public_key(copies.copies(own, places, ["doc"], 3, 5)).select("doc", "pos", "seed", "owner", "new", "located", "n_places")


@query("""
WITH c AS (SELECT c_custkey AS k, c_name AS v, 'Name: ' || CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'm', 'n') ELSE c_name END AS p,
  CASE WHEN c_custkey % 3 = 0 THEN ', ' || c_mktsegment ELSE '|' || c_mktsegment END AS rest FROM customer)
SELECT k AS c_custkey, substr(p, 7) AS printed, CASE WHEN k % 3 = 0 THEN ',' ELSE '' END AS after, CAST(6 AS DOUBLE) / length(p || rest) AS start,
  CAST(length(p) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) / length(p || rest) AS "end" FROM c
""")
def spans_read(spark, sf_dir):
    """Customers' names found in readings of their labels, with misread letters, cell borders and commas behind them."""
    key = F.col("c_custkey")
    printed = F.when(key % 2 == 0, F.replace("c_name", F.lit("m"), F.lit("n"))).otherwise(F.col("c_name"))
    read = F.concat(F.lit("Name: "), printed, F.when(key % 3 == 0, ", ").otherwise("|"), "c_mktsegment")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("value"), read.alias("reading"))
    return reading.read_spans(own, ["c_custkey"]).select("c_custkey", "span.printed", "span.after", "span.start", "span.end")


def _drawn(rows: list[tuple[str, int]]) -> Column:
    """A page's bytes from SQL for rows in hexadecimal, each so many times."""
    return F.expr("unhex(concat(" + ", ".join(f"repeat({row}, {n})" for row, n in rows) + "))")


def _row(width: int, *runs: tuple[str, str]) -> str:
    """SQL for a row of paper with ink from a column to another, in order."""
    out, at = [], "0"
    for start, end in runs:
        out += [f"repeat('F0', cast({start} - ({at}) as int))", f"repeat('00', cast({end} - ({start}) as int))"]
        at = end
    return "concat(" + ", ".join([*out, f"repeat('F0', cast({width} - ({at}) as int))"]) + ")"


@query("""
SELECT p_partkey, CAST(8 * (p_size + 3) AS BIGINT) AS gone, CAST(400 + 38 + 160 AS BIGINT) AS kept FROM part
""")
def values_erased(spark, sf_dir):
    """A value that a table line crosses is erased from drawn pages with what hangs out of its box; the line and its neighbour stay."""
    value, beside, line = ("20", "23 + p_size"), ("120", "140"), ("150", "151")
    blank, text, rule = _row(200, line), _row(200, value, beside, line), _row(200, ("0", "200"))
    gray = _drawn([(blank, 10), (text, 8), (blank, 12), (rule, 2), (blank, 8)])
    x1 = F.col("p_size") + 20
    pages = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.lit(200).alias("width"), F.lit(40).alias("height"), gray.alias("gray"), F.array(B.box(F.lit(20), F.lit(10), x1, F.lit(18))).alias("boxes"))
    dark = lambda c: (F.length(F.hex(c)) / 2 - F.length(F.replace(F.hex(c), F.lit("00"), F.lit(""))) / 2).cast("long")
    # What was there before goes along as a key, so no page is drawn or dealt out twice.
    done = pixels.values_erased(pages.withColumn("all", dark("gray")), ["p_partkey", "all"]).select("p_partkey", "all", dark("gray").alias("kept"))
    return done.select("p_partkey", (F.col("all") - F.col("kept")).alias("gone"), "kept")


@query("""
SELECT p_partkey, lpad(CAST(p_partkey + 7 AS VARCHAR), 8, '2') AS back, true AS valid, true AS number_kept FROM part
""")
def barcodes_redrawn(spark, sf_dir):
    """Bars beside a changed number, redrawn with the new number and read back from their pixels; the number's own are kept."""
    key = F.col("p_partkey")
    old, new = F.lpad(key.cast("string"), 8, "1"), F.lpad((key + 7).cast("string"), 8, "2")
    own = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", barcode.widths(old).alias("w"), barcode.widths(new).alias("modules"))
    bars = F.array_join(F.transform("w", lambda n, i: F.repeat(F.when(i % 2 == 0, "00").otherwise("F0"), 2 * n)), "")
    own = own.withColumn("bars", F.concat(F.repeat(F.lit("F0"), F.lit(20)), bars))
    own = own.withColumn("bars", F.concat("bars", F.repeat(F.lit("F0"), (400 - F.length("bars") / 2).cast("int"))))
    number = _row(400, *[(str(x), str(x + 5)) for x in range(20, 116, 8)])
    run = F.struct(B.box(F.lit(20), F.lit(44), F.lit(113), F.lit(54)).alias("b"))
    edit = F.array(F.struct("b.x0", "b.y0", "b.x1", "b.y1", key.alias("seed"), "modules"))
    pages = own.withColumn("gray", _drawn([(_row(400), 10), ("bars", 30), (_row(400), 4), (number, 10), (_row(400), 6)])).select("*", run["b"].alias("b"))
    pages = pages.select("p_partkey", F.lit(400).alias("width"), F.lit(60).alias("height"), F.lit(10).alias("line_height"), "gray", edit.alias("numbers"))
    rows = lambda c: F.substring(F.col(c), 44 * 400 + 1, 10 * 400)
    # The number's rows as they were go along as a key, so no page is drawn or dealt out twice.
    done = pixels.redrawn(pages.withColumn("old", rows("gray")), ["p_partkey", "old"]).withColumn("bar", F.get("bars", F.lit(0)))
    line = F.hex(F.substring(F.col("gray"), F.lit(25 * 400 + 1) + F.col("bar.x0"), F.col("bar.x1") - F.col("bar.x0")))
    dark = F.transform(F.regexp_extract_all(line, F.lit(".."), F.lit(0)), lambda x: x == "14")
    back = A.once(F.transform(A.once(dark, A.runs), lambda n: (n / 2).cast("int")), barcode.decode)
    return done.select("p_partkey", back.alias("back"), "bar.valid", (rows("gray") == F.col("old")).alias("number_kept"))


def _counting(images: list) -> list[str]:
    """A stand-in for a reader: says the number of columns with ink between two words."""
    return [f"Nr {1000000 + int((x < 128).any(axis=0).sum())} EUR" for x in images]


@query("""
SELECT p_partkey, CAST(1000027 + p_size % 20 AS VARCHAR) AS value, CAST(1000027 + p_size % 20 AS VARCHAR) AS printed, 30 AS x0, 20 AS y0, CAST(35 + p_size % 20 AS INT) AS x1, 30 AS y1, CAST(43 + p_size % 20 AS INT) AS next_x FROM part
""")
def places_by_pixels(spark, sf_dir):
    """Numbers that no text layer has, placed by the ink of drawn pages with a reader that is passed in."""
    text = _row(200, ("10", "20"), ("30", "35 + p_size % 20"), ("43 + p_size % 20", "55 + p_size % 20"))
    gray = _drawn([(_row(200), 20), (text, 10), (_row(200), 30)])
    own = dealt(spark, sf_dir, "part", "p_partkey").withColumn("gray", gray)
    pages = own.select("p_partkey", F.lit(200).alias("width"), F.lit(60).alias("height"), F.lit(10).alias("line_height"), "gray")
    wanted = own.select("p_partkey", (F.col("p_size") % 20 + 1000027).cast("string").alias("value"), B.box(F.lit(0), F.lit(0), F.lit(200), F.lit(60)).alias("hint"))
    lines = spark.createDataFrame([], "p_partkey bigint, word_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")
    found = location.by_pixels(wanted, pages, lines, ["p_partkey"], _counting)
    return found.select("p_partkey", "value", "printed", "box.x0", "box.y0", "box.x1", "box.y1", "next_x")


@query(f"""
WITH o AS (SELECT c_nationkey AS doc, CAST(c_custkey % 10 AS INT) AS page, c_custkey AS pos, c_mktsegment AS owner FROM customer),
r AS (SELECT doc, owner, row_number() OVER (PARTITION BY doc ORDER BY min((page, pos))) - 1 AS rank FROM o GROUP BY doc, owner),
s AS (SELECT unnest([5, 6]) AS seed),
i AS (SELECT doc, seed, owner, {_POOLS['first']}[{_HASH.format("doc, seed, owner, 'first'")} % 12 + 1] || ' ' || {_POOLS['last']}[({_HASH.format("doc, seed, 'last'")} + rank) % 10 + 1] AS name FROM r, s),
p AS (SELECT doc, page, count(*) AS n, bool_or(pos % 7 = 0) AS leaked FROM o GROUP BY doc, page)
SELECT doc, seed, page, pos, i.owner, name AS new, pos % 3 > 0 AS located, CAST(pos % 3 AS INT) AS n_places, pos % 3 > 0 AND pos % 5 > 0 AS read_back_ok,
  CAST(n AS INT) AS barcodes_scrambled, CASE WHEN leaked THEN 'person' ELSE '' END AS leaked_types, NOT leaked AS passed
FROM o JOIN i USING (doc, owner) JOIN p USING (doc, page)
""")
def page_keys(spark, sf_dir):
    """The page keys of two copies of customers' names: places read back, and pages on which old numbers are still to be read."""
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc"), (key % 10).cast("int").alias("page"), key.alias("pos"), F.col("c_mktsegment").alias("owner"), F.lit("person").alias("type"), F.concat(F.lit("Mr "), "c_name").alias("text")
    )
    many = F.when(F.col("pos") % 3 > 0, F.sequence(F.lit(1), (F.col("pos") % 3).cast("int")))
    places = own.select("doc", "page", "pos", F.explode(many).alias("place"), F.lit("exact").alias("how"), F.col("text").alias("printed"), F.lit(None).cast("int").alias("words"))
    changed = reading.once(copies.copies(own, places, ["doc"], 2, 5))
    seeds = F.explode(F.array(F.lit(5), F.lit(6))).alias("seed")
    box = B.box(F.lit(0), F.col("place") * 20, F.lit(90), F.col("place") * 20 + 10)
    spots = places.select("doc", seeds, "page", "pos", "place", box.alias("box"), (F.col("pos") % 5 > 0).alias("read_back_ok"), F.lit(None).cast(analysis.BOX).alias("barcode"), F.lit(None).cast("boolean").alias("barcode_valid"))
    # What a reader would say of a finished page: every seventh number stands there as it was.
    said = F.concat(F.lit("No "), F.when(F.col("pos") % 7 == 0, F.regexp_extract("text", "[0-9]+", 0)).otherwise("-"))
    pages = own.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list(said)), " ").alias("text"), F.count(F.lit(1)).cast("int").alias("barcodes_scrambled"))
    pages = pages.select("doc", seeds, "page", "barcodes_scrambled", "text", F.lit("").alias("context"))
    keys = finished.page_keys(changed, spots, pages, own.select("doc", "page", "type", "text"), ["doc"])
    rows = keys.select("doc", "seed", "page", F.inline("changes"), "barcodes_scrambled", "leak_check")
    return rows.select(
        "doc", "seed", "page", "pos", "owner", "new", "located", F.size("places").alias("n_places"), "read_back_ok", "barcodes_scrambled",
        F.array_join("leak_check.leaked_types", ", ").alias("leaked_types"), "leak_check.passed",
    )


@query("""
WITH w AS (SELECT item_id, text, split_part(text, ' ', 1) AS a, split_part(text, ' ', -1) AS z FROM benchmark)
SELECT item_id, replace(replace(text, a, ' '), z, ' ') AS context FROM w
""")
def contexts(spark, sf_dir):
    """What is left of benchmark items without their first word and, after that, without their last."""
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    values = own.select("item_id", F.lit(0).alias("pos"), F.element_at("w", 1).alias("text"))
    places = own.select("item_id", F.lit(1).alias("pos"), F.lit(0).alias("place"), F.element_at("w", -1).alias("printed"))
    return finished.context(own.select("item_id", "text"), values, places, ["item_id"])


@query("""
SELECT c_custkey, pos, CASE pos WHEN 0 THEN 'person' ELSE 'phone' END AS type, CASE pos WHEN 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS text, CASE pos WHEN 0 THEN 'exact' ELSE 'pixels' END AS how,
  CAST(c_custkey % 50 AS INT) AS x0, CAST(c_custkey % 50 + 9 AS INT) AS x1, CASE pos WHEN 0 THEN CAST(c_custkey % 50 + 12 AS INT) END AS next_x FROM customer, (SELECT unnest([0, 1]) AS pos)
""")
def analyses_read(spark, sf_dir):
    """Analyses of pages written as JSON and read again with all checks, a row for each place."""
    key = F.col("c_custkey")
    x = (key % 50).cast("int")
    box = B.box(x, F.lit(5), x + 9, F.lit(15))
    value = lambda n, kind, text: F.struct(F.lit(n).alias("pos"), F.lit("x").alias("owner"), F.lit(kind).alias("type"), text.alias("text"), box.alias("hint"))

    def place(n, how, text, next_x):
        words = F.lit(None).cast("struct<first:int,last:int>")
        fields = (F.lit(n).alias("pos"), F.lit(0).alias("place"), F.lit(how).alias("how"), text.alias("printed"), F.lit("").alias("before"), F.lit("").alias("after"))
        return F.struct(*fields, words.alias("words"), box.alias("line_box"), box.alias("run_box"), next_x.cast("int").alias("next_x"))

    name, number = F.col("c_name"), key.cast("string")
    values_ = F.array(value(0, "person", name), value(1, "phone", number)).cast(analysis.VALUES)
    places = F.array(place(0, "exact", name, x + 12), place(1, "pixels", number, F.lit(None))).cast(analysis.PLACES)
    back = table(spark, sf_dir, "customer").select("c_custkey", analysis.from_text(analysis.to_text(values_, places)).alias("x"))
    spots = back.select("c_custkey", "x.values", F.inline("x.places"))
    own = F.get("values", F.col("pos"))
    return spots.select("c_custkey", "pos", own["type"].alias("type"), own["text"].alias("text"), "how", "run_box.x0", "run_box.x1", "next_x")


@query("""
WITH t AS (SELECT l_suppkey, l_returnflag || l_linestatus AS option, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_suppkey, option, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, place, option) AS n FROM t) WHERE n = 1
""")
def styles_voted(spark, sf_dir):
    """The option that all samples of a group score highest together, the first of equal ones."""
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("option"), F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("long").alias("score"))
    return votes.winner(own, ["l_suppkey"])


# -- sources --------------------------------------------------------------------------------------

# Words of raw pages, eight to a line, on a grid in points.
_GRID = "SELECT page_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT page_id, regexp_extract_all(html, '[^\\x00-\\x20]+') AS w FROM pages)"
_SCALE = 150 / 72


@query(f"""
WITH g AS ({_GRID}), b AS (SELECT page_id, i // 8 AS row, i, t, 72 + 40 * (i % 8) AS x, 40 + 12 * (i // 8) AS y FROM g)
SELECT page_id, CAST(row AS INT) AS line, string_agg(t, ' ' ORDER BY i) AS text, CAST(trunc(min(x) * CAST({_SCALE} AS DOUBLE)) AS INT) AS x0, CAST(trunc(min(y) * CAST({_SCALE} AS DOUBLE)) AS INT) AS y0,
  CAST(round_even((max(x) + 30.5) * CAST({_SCALE} AS DOUBLE), 0) AS INT) AS x1, CAST(round_even((max(y) + 10.25) * CAST({_SCALE} AS DOUBLE), 0) AS INT) AS y1 FROM b GROUP BY page_id, row
""")
def text_layers(spark, sf_dir):
    """Lines of the text layers that the words of raw pages make, written as XHTML with their boxes and read again."""
    words = F.regexp_extract_all("html", F.lit(r"[^\x00-\x20]+"), F.lit(0))
    safe = F.expr("""transform(w, t -> replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))""")
    rows = F.expr("""transform(sequence(0, int((size(s) - 1) div 8)), r -> concat('<line>\n', array_join(transform(slice(s, r * 8 + 1, 8), (t, k) -> concat(
      '<word xMin="', 72 + 40 * k, '" yMin="', 40 + 12 * r, '" xMax="', 102 + 40 * k, '.5" yMax="', 50 + 12 * r, '.25">', t, '</word>')), '\n'), '</line>'))""")
    own = dealt(spark, sf_dir, "pages", "page_id").select("page_id", words.alias("w")).where("size(w) > 0").select("page_id", safe.alias("s"))
    layers = own.select("page_id", F.concat(F.lit("<page>"), F.array_join(rows, "\n"), F.lit("</page>")).alias("xml"))
    found = S.text_layer(layers, ["page_id"])
    return found.select("page_id", "line", F.array_join("words", " ").alias("text"), "box.x0", "box.y0", "box.x1", "box.y1")


# A recognizer's table of the same words, six to a row, each third one joined to the next by a bar, blanks wider in the middle.
_TABLE = f"""SELECT page_id, n // 6 AS row, n % 6 AS k, text, 10 + 100 * (n % 6) + CASE WHEN n % 6 > 2 THEN 60 ELSE 0 END AS x, 10 + 20 * (n // 6) AS y FROM (
  SELECT page_id, i // 3 * 2 + CASE WHEN i % 3 = 2 THEN 1 ELSE 0 END AS n, string_agg(t, '|' ORDER BY i) AS text FROM ({_GRID}) GROUP BY ALL)"""
_READ = f"""
WITH r AS ({_TABLE}), p AS (SELECT *, string_split(text, '|') AS s FROM r),
q AS (SELECT *, unnest(s) AS part, unnest(range(len(s))) AS j FROM p),
o AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY page_id, row, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, trim(part, '|[]\\{{}}') AS clean FROM q),
w AS (SELECT page_id, row, clean AS t, x + CAST(floor(90 * before / CAST(length(text) AS DOUBLE)) AS INT) AS x0, x + CAST(floor(90 * (before + length(part)) / CAST(length(text) AS DOUBLE)) AS INT) AS x1, y FROM o WHERE clean <> ''),
c AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, row ORDER BY x0, x1, t) > 36 THEN 1 ELSE 0 END AS cut FROM w),
g AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, row ORDER BY x0, x1, t ROWS UNBOUNDED PRECEDING) AS part FROM c),
l AS (SELECT page_id, string_agg(t, ' ' ORDER BY x0, x1, t) AS text, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, min(y) + 12 AS y1 FROM g GROUP BY page_id, row, part),
n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0, x0) - 1 AS INT) AS line, text, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM l)
"""


def _recognized_lines(spark, sf_dir):
    words = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"[^\x00-\x20]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    cells = F.expr("transform(sequence(0, int(size(w) div 3 * 2 + if(size(w) % 3 > 0, 0, -1))), n -> array_join(slice(w, n div 2 * 3 + 1 + n % 2 * 2, 2 - n % 2), '|'))")
    grid = words.select("page_id", F.posexplode(cells).alias("n", "text"))
    place = ("int(n div 6) as line_num", "int(10 + 100 * (n % 6) + if(n % 6 > 2, 60, 0)) as left", "int(10 + 20 * (n div 6)) as top")
    read = grid.select("page_id", F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), *map(F.expr, place), F.lit(90).alias("width"), F.lit(12).alias("height"), "text")
    return S.group_lines(S.words(read, ["page_id"]), ["page_id"])


@query(_READ + "SELECT * FROM n")
def recognizer_lines(spark, sf_dir):
    """Lines grouped from a recognizer's table of the words of raw pages: cells parted at bars, rows at wide blanks."""
    return _recognized_lines(spark, sf_dir).select("page_id", "line", F.array_join("words", " ").alias("text"), "box.x0", "box.y0", "box.x1", "box.y1")


@query(_READ + "SELECT page_id, md5(string_agg(text, chr(10) ORDER BY line)) AS digest, count(*) AS n_lines FROM n GROUP BY page_id")
def page_texts(spark, sf_dir):
    """The text of each page, as its grouped lines make it."""
    text = S.page_text(_recognized_lines(spark, sf_dir), ["page_id"])
    return text.select("page_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("""
SELECT l_orderkey AS doc, l_linenumber % 3 + 1 AS page FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL HAVING count(*) = 1
""")
def scanned_pages(spark, sf_dir):
    """Pages with one image in listings of documents' images."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("  ", F.lit(" "), F.col("l_linenumber") % 3 + 1, F.lit("0"), F.when(F.col("l_returnflag") == "N", "smask").otherwise("image"), F.lit("1653 2339")).alias("row"))
    listing = F.concat(F.lit("page num type width height\n----\n"), F.array_join(F.array_sort(F.collect_list("row")), "\n"))
    return S.scanned_pages(own.groupBy(F.col("l_orderkey").alias("doc")).agg(listing.alias("listing")), ["doc"])


# -- measures -------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INT)) AS l FROM documents WHERE text <> ''),
s AS (SELECT doc_id, list_sort(l) AS l, len(l) AS n FROM b), p AS (SELECT *, l[least(n - 1, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT)) + 1] AS paper, l[n // 20 + 1] AS dark, l[least(n - 1, n * 9 // 10) + 1] AS light FROM s),
d AS (SELECT *, list_sort(list_transform(list_filter(l, lambda v: v >= paper - 30), lambda v: abs(v - paper))) AS d, list_filter(l, lambda v: v < paper - 70) AS ink FROM p)
SELECT doc_id, paper, CAST(1.4826 AS DOUBLE) * d[len(d) // 2 + 1] AS noise, CASE WHEN light - dark > 40 THEN (dark + light) // 2 ELSE dark - 1 END AS shape_cut,
  CASE WHEN len(ink) = 0 THEN 15 ELSE CAST(list_sum(ink[1 : greatest(1, len(ink) // 3)]) // greatest(1, len(ink) // 3) AS INT) END AS ink FROM d
""")
def level_statistics(spark, sf_dir):
    """Paper, grain, shape cut and ink of the bytes of whole texts, taken as gray levels: order statistics of one count of levels each."""
    gray = F.encode("text", "UTF-8")
    own = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.octet_length("text").alias("width"), F.lit(1).alias("height"), gray.alias("gray"))
    return measures.level_statistics(own, ["doc_id"])


@query("""
SELECT p_partkey AS page, 'v' AS value, 20 AS x0, 14 AS y0, CAST(20 + p_size AS INT) AS x1, 22 AS y1, 170 AS cut, 240 AS paper, CAST(0 AS DOUBLE) AS noise, 0 AS ink, CASE WHEN p_size > 1 THEN 120 ELSE -1 END AS shape_cut, CASE WHEN p_size > 1 THEN 8 ELSE 0 END AS body,
  CAST(30 + p_size + p_partkey % 7 AS INT) AS "right", CAST(p_partkey % 5 + 2 AS INT) AS above, 12 AS below FROM part
""")
def ink_measures(spark, sf_dir):
    """Measures of a value on drawn pages: a cell line through it, another word to its right and one above it."""
    value = "20 + p_size"
    right = f"{value} + 10 + p_partkey % 7"
    gap = "(p_partkey % 5 + 3)"
    row = lambda *runs: _row(200, *runs)
    ink = row(("20", "20 + p_size - p_size div 2"), (right, f"{right} + 5"))
    drawn = [(row(), f"(13 - {gap})"), (row(("20", "21")), 1), (row(), gap), (ink, 8), (row(), 30)]
    box = f"named_struct('x0', 20, 'y0', 12, 'x1', int({value}), 'y1', 24)"
    values = F.expr(f"array(named_struct('value', 'v', 'line', {box}, 'run', {box}))").alias("values")
    own = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("page"), F.lit(200).alias("width"), F.lit(52).alias("height"), _drawn(drawn).alias("gray"), values)
    return measures.measured(own, ["page"])


# -- reports --------------------------------------------------------------------------------------


@query(f"""
WITH a AS (SELECT DISTINCT 'all' AS doc, {_NORM.format('w')} AS v FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark)),
b AS (SELECT DISTINCT 'all' AS doc, {_NORM.format('w')} AS v FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM conversations))
SELECT doc, count(*) FILTER (x) AS n_a, count(*) FILTER (y) AS n_b, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (x AND NOT y) AS n_only_a, count(*) FILTER (y AND NOT x) AS n_only_b
FROM (SELECT coalesce(a.doc, b.doc) AS doc, a.v IS NOT NULL AS x, b.v IS NOT NULL AS y FROM a FULL JOIN b ON a.doc = b.doc AND a.v = b.v) GROUP BY doc
""")
def agreement(spark, sf_dir):
    """How far the words of benchmark and conversations agree: intersection and differences."""
    words = lambda name: table(spark, sf_dir, name).select(F.lit("all").alias("doc"), F.explode(F.split("text", r"\s+")).alias("text"))
    return report.agreement(words("benchmark"), words("conversations"))


@query("""
WITH c AS (SELECT 'sim' AS set, l_orderkey % 50 AS doc, l_linenumber AS page, l_quantity > 10 AS located, l_quantity > 20 AS edited, l_returnflag = 'N' AS ok, l_returnflag AS flag FROM lineitem),
p AS (SELECT set, doc, page, count(*) AS bars, bool_or(flag = 'R') AS leaked FROM c GROUP BY ALL),
q AS (SELECT set, doc, count(*) AS n_pages, CAST(sum(bars) AS BIGINT) AS n_barcodes, CASE WHEN bool_or(leaked) THEN 'failed: id' ELSE 'passed' END AS leak_check FROM p GROUP BY ALL)
SELECT q.*, n_values, n_located, n_edited, n_read_back FROM q JOIN (
  SELECT set, doc, count(*) AS n_values, count(*) FILTER (located) AS n_located, count(*) FILTER (edited) AS n_edited, count(*) FILTER (edited AND ok) AS n_read_back FROM c GROUP BY ALL) USING (set, doc)
""")
def evaluation(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(
        F.lit("sim").alias("set"), (F.col("l_orderkey") % 50).alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") > 10).alias("located"),
        F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("places"), (F.col("l_returnflag") == "N").alias("read_back_ok"), "l_returnflag",
    )
    leaked = F.when(F.bool_or(F.col("l_returnflag") == "R"), F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    pages = own.groupBy("set", "doc", "page").agg(F.count(F.lit(1)).alias("barcodes_scrambled"), leaked.alias("leaked_types"))
    return report.evaluation(own.drop("l_returnflag"), pages)


_CHANGES = "SELECT ['real', 'sim', 'digital', 'other'][l_suppkey % 4 + 1] AS set, l_orderkey % 50 AS doc, l_suppkey % 3 AS copy, l_linenumber AS page, l_returnflag AS type, l_linestatus AS owner, 'v' || (l_partkey % 100) || '&' AS new, l_quantity > 10 AS located, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS places, l_quantity > 25 AS read_back_ok FROM {0}"


def _changes(spark, sf_dir):
    """Public changes of copies, made of line items."""
    kind = F.get(F.array(*map(F.lit, ("real", "sim", "digital", "other"))), (F.col("l_suppkey") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        kind.alias("set"), (F.col("l_orderkey") % 50).alias("doc"), (F.col("l_suppkey") % 3).alias("copy"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("owner"),
        F.concat(F.lit("v"), F.col("l_partkey") % 100, F.lit("&")).alias("new"), (F.col("l_quantity") > 10).alias("located"), F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("places"), (F.col("l_quantity") > 25).alias("read_back_ok"),
    )


def _page_verdicts(changed, keys):
    leaked = F.when(F.bool_or(F.col("type") == "R"), F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    return changed.groupBy(*keys).agg((F.count(F.lit(1)) % 3).alias("barcodes_scrambled"), leaked.alias("leaked_types"))


@query(f"""
WITH c AS (SELECT * FROM ({_CHANGES.format('lineitem')}) WHERE copy = 1 AND set <> 'other'),
p AS (SELECT set, doc, page, count(*) % 3 AS bars, bool_or(type = 'R') AS leaked FROM c GROUP BY ALL),
q AS (SELECT set, doc, count(*) AS n_pages, CAST(sum(bars) AS BIGINT) AS n_bars, CASE WHEN bool_or(leaked) THEN 'failed: id' ELSE 'passed' END AS verdict FROM p GROUP BY ALL),
v AS (SELECT set, doc, count(*) AS a, count(*) FILTER (located) AS b, count(*) FILTER (places > 0) AS c, count(*) FILTER (places > 0 AND read_back_ok) AS d FROM c GROUP BY ALL)
SELECT CAST(list_position(['real', 'sim', 'digital'], set) AS INT) AS place, set, doc, '| ' || concat_ws(' | ', set, doc, n_pages, a, b, c, d, n_bars, verdict) || ' |' AS row FROM q JOIN v USING (set, doc)
""")
def evaluation_table(spark, sf_dir):
    """The evaluation of first copies as lines of a table, sets in their order."""
    changed = _changes(spark, sf_dir)
    return report.evaluation_table(changed, _page_verdicts(changed, ["set", "doc", "copy", "page"]))


@query(f"""
SELECT CAST(grouping(set) + grouping(doc) + grouping(type) AS INT) AS level, set, doc, type, count(*) AS n_values, count(*) FILTER (located) AS n_located, count(*) FILTER (located AND read_back_ok) AS n_read_back
FROM ({_CHANGES.format('lineitem')}) GROUP BY GROUPING SETS ((set, doc, type), (set, doc), (set), ())
""")
def change_totals(spark, sf_dir):
    """Counts of changes by type in each document, by document, by set and over all."""
    return report.totals(_changes(spark, sf_dir))


@query(f"""
WITH c AS ({_CHANGES.format('lineitem')}), p AS (SELECT doc, copy, page, count(*) % 3 AS bars, count(*) AS n, count(*) FILTER (read_back_ok) AS ok, bool_or(type = 'R') AS leaked,
  string_agg('<tr><td>' || type || ' (' || owner || ')<td>' || replace(new, '&', '&amp;') || '<td>' || CASE WHEN NOT located THEN 'not located' WHEN read_back_ok THEN 'yes' ELSE 'no' END || '</tr>', ''
    ORDER BY type, owner, new, CASE WHEN NOT located THEN 'not located' WHEN read_back_ok THEN 'yes' ELSE 'no' END) AS body FROM c GROUP BY ALL),
t AS (SELECT *, 'copy-' || copy || ': ' || ok || '/' || n || ' values replaced and read back' || CASE WHEN bars > 0 THEN ', ' || bars || ' barcodes scrambled' ELSE '' END AS title FROM p)
SELECT doc, page, list(title ORDER BY copy) AS titles, md5('<div>' || string_agg('<figure><figcaption>' || title || '</figcaption><p>Leak check ' || CASE WHEN leaked THEN 'failed for: id' ELSE 'passed' END || '</p><table>' || body || '</table></figure>', '' ORDER BY copy) || '</div>') AS digest
FROM t GROUP BY doc, page
""")
def page_rows(spark, sf_dir):
    """A page's copies side by side, as a person looks at them."""
    changed = _changes(spark, sf_dir)
    rows = report.page_rows(changed, _page_verdicts(changed, ["doc", "copy", "page"]))
    return rows.select("doc", "page", "titles", F.md5(F.encode("html", "UTF-8")).alias("digest"))
