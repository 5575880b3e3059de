"""Reports on copies and documents: counts, verdicts, agreement of detections, and a page to look at."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import norm

SETS = ("real", "sim", "digital")


def evaluation(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each set and document.

    ``changed(set, doc, page, located, places, read_back_ok)``,
    ``pages(set, doc, page, barcodes_scrambled, leaked_types)``.
    """
    edited = F.col("places") > 0
    counts = changed.groupBy("set", "doc").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if("located").alias("n_located"),
        F.count_if(edited).alias("n_edited"),
        F.count_if(edited & F.col("read_back_ok")).alias("n_read_back"),
    )
    by_page = pages.groupBy("set", "doc").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("barcodes_scrambled").alias("n_barcodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaked_types")))).alias("leaked"),
    )
    verdict = F.when(F.size("leaked") == 0, "passed").otherwise(F.concat(F.lit("failed: "), F.array_join("leaked", ", ")))
    return by_page.join(counts, ["set", "doc"], "left").withColumn("leak_check", verdict).drop("leaked").na.fill(0)


COLUMNS = ("n_pages", "n_values", "n_located", "n_edited", "n_read_back", "n_barcodes", "leak_check")


def evaluation_table(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """(place, set, doc, row): the evaluation of first copies as lines of a table, sets in their order, then by document.

    Inputs are those of ``evaluation`` with a column ``copy``. Other copies and other sets than ``SETS`` aren't in the table.
    ``place`` is the set's, from one on; together with ``doc`` it gives the order in which lines are written.
    """
    place = F.array_position(F.array(*map(F.lit, SETS)), F.col("set")).cast("int")
    first = lambda df: df.where((F.col("copy") == 1) & F.col("set").isin(*SETS)).drop("copy")
    own = evaluation(first(changed), first(pages)).withColumn("place", place)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "set", F.col("doc").cast("string"), *[F.col(x).cast("string") for x in COLUMNS]), F.lit(" |"))
    return own.select("place", "set", "doc", row.alias("row")).orderBy("place", "doc")


def totals(changed: DataFrame) -> DataFrame:
    """(level, set, doc, type, n_values, n_located, n_read_back): counts by type in each document, by document, by set and over all.

    ``level`` counts how many of the three columns are summed over; those are null.
    """
    set_, doc, kind = F.col("set"), F.col("doc"), F.col("type")
    grouped = changed.groupingSets([[set_, doc, kind], [set_, doc], [set_], []], set_, doc, kind)
    counts = grouped.agg(
        (F.grouping("set") + F.grouping("doc") + F.grouping("type")).cast("int").alias("level"),
        F.count(F.lit(1)).alias("n_values"),
        F.count_if("located").alias("n_located"),
        F.count_if(F.col("located") & F.col("read_back_ok")).alias("n_read_back"),
    )
    return counts.select("level", "set", "doc", "type", "n_values", "n_located", "n_read_back")


def page_rows(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, titles, html): a page's copies side by side, each with a title of what was done and its key.

    ``changed(doc, copy, page, type, owner, new, located, read_back_ok)``, ``pages(doc, copy, page, barcodes_scrambled,
    leaked_types)``. Only new values are shown. ``leaked_types`` null says that no leak check was made. Rows of a key are by
    type, owner and new value.
    """
    keys, safe = ["doc", "copy", "page"], lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    status = verdict(F.col("located"), F.col("read_back_ok"))
    cells = F.concat(F.lit("<tr><td>"), safe(F.col("type")), F.lit(" ("), safe(F.col("owner")), F.lit(")<td>"), safe(F.col("new")), F.lit("<td>"), status, F.lit("</tr>"))
    own = changed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("read_back_ok").alias("n_ok"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "owner", "new", cells.alias("cells")))), lambda x: x["cells"]), "").alias("body"),
    )
    both = pages.join(own, keys, "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_ok", F.lit(0))
    bars = F.when(F.col("barcodes_scrambled") > 0, F.concat(F.lit(", "), F.col("barcodes_scrambled").cast("string"), F.lit(" barcodes scrambled"))).otherwise(F.lit(""))
    title = F.concat(F.lit("copy-"), F.col("copy").cast("string"), F.lit(": "), ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" values replaced and read back"), bars)
    leaks = F.when(F.size("leaked_types") > 0, F.concat(F.lit("<p>Leak check failed for: "), safe(F.array_join("leaked_types", ", ")), F.lit("</p>")))
    leaks = F.when(F.col("leaked_types").isNull(), F.lit("")).otherwise(F.coalesce(leaks, F.lit("<p>Leak check passed</p>")))
    card = F.concat(F.lit("<figure><figcaption>"), safe(title), F.lit("</figcaption>"), leaks, F.lit("<table>"), F.coalesce("body", F.lit("")), F.lit("</table></figure>"))
    side = both.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("copy", title.alias("title"), card.alias("card")))).alias("c"))
    cards = F.array_join(F.transform("c", lambda x: x["card"]), "")
    return side.select("doc", "page", F.transform("c", lambda x: x["title"]).alias("titles"), F.concat(F.lit("<div>"), cards, F.lit("</div>")).alias("html"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, n_a, n_b, n_both, n_only_a, n_only_b) of distinct normal forms; inputs are (doc, text)."""
    one = a.select("doc", norm(F.col("text")).alias("v")).distinct().withColumn("in_a", F.lit(True))
    two = b.select("doc", norm(F.col("text")).alias("v")).distinct().withColumn("in_b", F.lit(True))
    x, y = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return one.join(two, ["doc", "v"], "full").groupBy("doc").agg(
        F.count_if(x).alias("n_a"),
        F.count_if(y).alias("n_b"),
        F.count_if(x & y).alias("n_both"),
        F.count_if(x & ~y).alias("n_only_a"),
        F.count_if(~x & y).alias("n_only_b"),
    )


def page_report(values: DataFrame, located: DataFrame, candidates: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a page: values, located ones, places by how they were found, and candidates left open."""
    places = located.groupBy(*keys).agg(
        F.countDistinct("value").alias("n_located"), F.count(F.lit(1)).alias("n_places"), F.count_if(F.col("how") == "pixels").alias("n_by_pixels")
    )
    out = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).join(places, keys, "full")
    out = out.join(candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates")), keys, "full")
    return out.join(open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unconfirmed")), keys, "full").na.fill(0)


def verdict(located, read_back_ok):
    """What a row of the key table says of a change."""
    return F.when(~located, "not located").when(read_back_ok, "yes").otherwise("no")


def key_page(keys: DataFrame, most: int = 10_000) -> str:
    """An HTML table of public changes (page, type, owner, new, located, read_back_ok), for a person to read.

    A page for looking at takes ``most`` rows; more is an error, not a cut.
    """
    rows = keys.select("page", "type", "owner", "new", verdict(F.col("located"), F.col("read_back_ok")).alias("status")).orderBy("page", "type", "new").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} changes; select some first")
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>\n" for r in rows)
    return f"<table>\n<tr><th>page<th>type<th>owner<th>new<th>read back</tr>\n{body}</table>\n"
