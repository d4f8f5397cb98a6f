"""Links of more pages than are read at once."""

from pyspark.sql import functions as F

from postingflow.functions import html
from postingflow.functions.html import page_links, selected_elements


def test_links_of_many_pages(spark):
    assert html.LINK_PAGES <= 64
    pages = [None if i % 50 == 7 else "".join(f'<a class="c{i}" href="/{i}/{k}">t{k} é</a>' for k in range(i % 4)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(1)
    got = {r["id"]: [x.asDict() for x in r["links"]] for r in df.select("id", page_links(F.col("html")).alias("links")).collect()}
    assert got == {i: selected_elements(p, "a") for i, p in enumerate(pages)}
