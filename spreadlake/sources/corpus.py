"""Scans over page and document corpora: links, capture choice, printed table rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import text
from spreadlake.operators.ranking import top_k


def page_links(pages: DataFrame, page: str, html: str, href_pattern: str | None = None) -> DataFrame:
    """Distinct (page, href, folded title) of every anchor."""
    title = text.fold(F.regexp_replace(F.col("title"), r"<[^>]*>", ""))
    links = pages.select(page, F.inline(text.href_pairs(html)).alias("href", "title")).select(
        page, "href", title.alias("title")
    )
    if href_pattern:
        links = links.filter(F.col("href").rlike(href_pattern))
    return links.distinct()


def wanted_titles(links: DataFrame, pages: DataFrame, page: str, wanted: Sequence[str]) -> DataFrame:
    """Exactly one href per wanted title and page, or the word for what is wrong."""
    hits = links.filter(F.col("title").isin(*wanted)).groupBy(page, "title").agg(
        F.countDistinct("href").alias("hrefs"), F.min("href").alias("href")
    )
    asked = pages.select(page, F.explode(F.array(*[F.lit(w) for w in wanted])).alias("title"))
    out = asked.join(hits, [page, "title"], "left")
    status = F.when(F.col("hrefs").isNull(), "missing").when(F.col("hrefs") > 1, "ambiguous").otherwise("ok")
    return out.withColumn("status", status).withColumn("href", F.when(F.col("status") == "ok", F.col("href")))


def missing_years(df: DataFrame, keys: Sequence[str], year: str, first: int, last: int) -> DataFrame:
    """Years of a declared range no row of the key carries."""
    have = df.groupBy(*keys, year).agg(F.count("*").alias("_n")).select(*keys, year)
    asked = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    )
    return asked.join(have, [*keys, year], "left_anti")


def rank_captures(
    df: DataFrame, keys: Sequence[str], canonical: Column, length: str, stamp: str, capture: str, keep: int = 3
) -> DataFrame:
    """Best capture per issue: canonical address, then longest, then newest; the next ones as alternates."""
    order = [canonical.cast("int").desc(), F.col(length).desc(), F.col(stamp).desc()]
    ranked = top_k(df, keys, order, keep, rank="choice")
    chosen = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("choice") == 1, F.col(capture))).alias("best"),
        F.array_sort(
            F.collect_list(F.when(F.col("choice") > 1, F.struct("choice", F.col(capture).alias("capture"))))
        ).alias("_alt"),
    )
    counted = df.groupBy(*keys).agg(F.count("*").alias("candidates"))
    return chosen.join(counted, list(keys)).withColumn(
        "alternates", F.transform("_alt", lambda x: x["capture"])
    ).drop("_alt")


def _read_lines(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Every line of every text with its tokens and how many of them are its label.

    What a function over an array binds is computed once, while a column that several others use is
    computed again for each of them where the optimizer merges the steps.
    """
    tokens = F.transform(F.split(body, "\n"), lambda x: text.row_tokens(x))
    cut = F.transform(tokens, lambda t: F.struct(t.alias("tokens"), text.label_length(t).alias("cut")))
    lines = docs.select(doc, F.posexplode(cut).alias("line", "_l"))
    return lines.select(doc, "line", F.col("_l.tokens").alias("_t"), F.col("_l.cut").alias("_cut"))


def printed_lines(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Every line of every text with what it is: ``row``, or why it is none.

    A row has a label and numbers behind it. ``blank`` has nothing, ``no_label`` numbers only,
    ``number_inside`` numbers before its last word only and ``no_number`` none at all.
    """
    kind = (
        F.when(F.size("_t") == 0, "blank").when(F.col("_cut") == 0, "no_label").when(F.col("_cut") < F.size("_t"), "row")
        .when(F.exists("_t", text.is_number_token), "number_inside").otherwise("no_number")
    )
    return _read_lines(docs, doc, body).withColumn("kind", kind)


def table_rows(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """Printed rows of every text: line number, label, folded key, numeric tokens and how many these are."""
    rows = _read_lines(docs, doc, body).filter("_cut > 0 and _cut < size(_t)")
    label, count = F.slice("_t", F.lit(1), F.col("_cut")), F.size("_t") - F.col("_cut")
    numbers = F.slice("_t", F.col("_cut") + 1, count)
    return rows.select(
        doc, "line", F.array_join(label, " ").alias("label"),
        # tokens hold no white space, so joined by nothing they are the folded label
        F.lower(F.array_join(label, "")).alias("label_key"),
        F.transform(numbers, lambda t: text.token_value(t)).alias("values"),
        F.exists(numbers, lambda t: t.endswith("R")).alias("revised"), count.alias("numbers"),
    )


def html_rows(
    pages: DataFrame, page: str, html: str, rows: Sequence[str] = ("tr",), cells: Sequence[str] = ("td", "th")
) -> DataFrame:
    """Every table row of every page with its cells, or why it holds no figures.

    ``rows`` and ``cells`` name the tags; lists are rows of ``li``. Comments, scripts and styles are
    taken out first, a tag left open ends where the next one of its kind begins. A cell is its text
    with tags out, the common entities decoded and white space folded. ``label`` joins the cells up to
    the last that is no number, ``values`` are the numbers behind it. ``kind`` is ``row``, or
    ``no_cells``, ``no_label`` or ``no_number``.
    """
    clean = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")

    def inside(source: Column, tags: Sequence[str], stop: str) -> Column:
        names = "|".join(tags)
        return F.regexp_extract_all(source, F.lit(rf"(?is)<(?:{names})\b[^>]*>(.*?)(?=</?(?:{names}{stop})\b|\z)"), F.lit(1))

    found = pages.select(page, F.posexplode(inside(clean, rows, "|table")).alias("row", "_row"))
    texts = F.transform(inside(F.col("_row"), cells, ""), cell_text)
    found = found.select(page, "row", texts.alias("cells"))
    numbers = F.transform("cells", lambda c: text.parse_number(c))
    cut = F.coalesce(F.array_max(F.transform(numbers, lambda v, i: F.when(v.isNull(), i + 1).otherwise(0))), F.lit(0))
    tail = F.slice(numbers, cut + 1, F.greatest(F.size("cells") - cut, F.lit(0)))
    kind = (
        F.when(F.size("cells") == 0, "no_cells").when(cut == 0, "no_label").when(cut == F.size("cells"), "no_number").otherwise("row")
    )
    label = F.array_join(F.slice("cells", F.lit(1), cut), " ")
    return found.select(page, "row", "cells", label.alias("label"), tail.alias("values"), kind.alias("kind"))


# The entities that pages print most, as HTML defines them.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&minus;", "-"), ("&ndash;", "-"), ("&amp;", "&"))


def cell_text(cell: Column) -> Column:
    """The text of a cell: tags out, entities decoded (``&amp;`` last), white space folded."""
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def slot_rows(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows whose folded label names a slot of the literal label dimension."""
    return rows.join(F.broadcast(slots), "label_key")


def issue_month(body: Column, marker: str, months: Mapping[str, int]) -> Column:
    """Month printed on a line that also carries the report's running head, as yyyy-mm."""
    names = "|".join(months)
    head = F.regexp_extract(body, rf"(?im)^[^\n]*{marker}[^\n]*$", 0)
    name = F.lower(F.regexp_extract(head, rf"(?i)\b({names})\s+((?:19|20)\d\d)", 1))
    year = F.regexp_extract(head, rf"(?i)\b({names})\s+((?:19|20)\d\d)", 2)
    number = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])[name]
    return F.when(year != "", F.format_string("%s-%02d", year, number))
