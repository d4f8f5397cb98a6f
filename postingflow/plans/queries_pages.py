"""Registered queries: raw pages and payloads to postings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postingflow.config import SourceConfig
from postingflow.functions import columns as C
from postingflow.functions.html import html_to_text, page_sections
from postingflow.plans.queries_snapshots import as_text
from postingflow.plans.registry import query
from postingflow.plans.views import over_postings, postings, table
from postingflow.plans import sqltext as Q
from postingflow.session import spread
from postingflow.sources import payloads

SITE = SourceConfig(
    name="example", search_base_url="https://jobs.example.org/search/?q=",
    jobs_base_url="https://jobs.example.org", link_selector="a.jobTitle-link", salary_factor=14,
)
DAY = dt.date(2024, 2, 15)


def _pages(spark, sf):
    return spread(table(spark, sf, "pages"))


def unescaped(column: str) -> str:
    """The entities that occur in the pages, in SQL; ``&amp`` also without its semicolon."""
    out = column
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&middot;", "'·'"), ("&copy;", "'©'")):
        out = f"replace({out}, '{entity}', {char})"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


@query("x1_page_links",
       "SELECT page_id, href, text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, "
       f"{unescaped('''unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2))''')} AS text FROM pages)")
def x1(spark, sf):
    return payloads.listing_links(_pages(spark, sf).select("page_id", "html"), "nav li a").select("page_id", "href", "text")


@query("x2_id_from_url", over_postings(
    "SELECT page_id AS id, nullif(regexp_extract(url, '[0-9]+', 0), '') AS first_id, nullif(regexp_extract(url, '/([0-9]+)/$', 1), '') AS trailing_id FROM pages "
    "UNION ALL SELECT doc_id, nullif(regexp_extract(url, '[0-9]+', 0), ''), nullif(regexp_extract(url, '/([0-9]+)/$', 1), '') FROM postings"))
def x2(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionByName(
        postings(spark, sf).select(F.col("doc_id").alias("id"), "url")
    )
    return urls.select(
        "id", C.id_from_url(F.col("url")).alias("first_id"), C.trailing_id_from_url(F.col("url")).alias("trailing_id")
    )


@query("x3_full_page",
       "SELECT page_id, n AS links, n IN (4, 5) AS is_full FROM (SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS n FROM pages)")
def x3(spark, sf):
    """Pages are complete here at 4 or 5 links (the sizes are a parameter)."""
    return payloads.page_completeness(_pages(spark, sf).select("page_id", "html"), "a", sizes=(4, 5))


@query("x4_html_to_text",
       "SELECT page_id, md5(" + unescaped(
           "regexp_replace(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<[^>]*>', '', 'g')"
       ) + ") AS text_md5 FROM pages")
def x4(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(html_to_text(F.col("html"))).alias("text_md5"))


@query("x5_list_sections",
       "SELECT page_id, " + unescaped(
           "regexp_replace(regexp_extract(html, '<nav>.*?<ul>(.*?)</ul>', 1, 's'), '<[^>]*>', '', 'g')"
       ) + " AS sections FROM pages")
def x5(spark, sf):
    read = _pages(spark, sf).select("page_id", page_sections(F.col("html"), "nav").alias("p"))
    return read.select("page_id", F.array_join("p.sections", "|").alias("sections"))


def _listing(spark, sf):
    """A listing response per posting: the posting, an advertisement, and its source's
    own posting, which therefore appears on very many pages."""
    df = postings(spark, sf)

    def item(pid, title, company, locations, salary, link):
        return F.struct(F.struct(
            pid.alias("id"), title.alias("title"), F.struct(company.alias("name")).alias("company"),
            F.transform(locations, lambda x: F.struct(x.alias("name"))).alias("locations"), salary.alias("salary"),
            F.lit(True).alias("isActive"), F.lit(False).alias("isHomeOffice"), F.array(F.lit("Vollzeit")).alias("employmentTypes"),
            link.alias("link"), title.alias("snippet"), F.col("collected_on").cast("string").alias("date"),
        ).alias("jobsItem"))

    own = item(F.col("doc_id").cast("string"), F.col("title"), F.col("company"), F.col("locations"), F.col("salary"), F.col("url"))
    shared = item(F.concat(F.lit("s"), "source"), F.col("source"), F.col("source"), F.array(F.lit("Wien")), F.lit("3.500,00"), F.col("source"))
    parts = [F.to_json(own), F.lit('{"alarmDisruptor":{"x":1}}'), F.to_json(shared)]
    body = F.concat(
        F.lit('{"data":{"jobsSearchList":{"activeItems":{"items":['), F.concat_ws(",", *parts), F.lit("]}}}}")
    )
    return df.select(body.alias("body"), F.col("lang_label").alias("query"), F.col("doc_id").alias("seq"))


@query("s9_parse_listing_json", over_postings(
    "SELECT 'example' || CAST(doc_id AS VARCHAR) AS posting_id, title, company, array_to_string(locations, '|') AS locations, monthly AS salary_monthly_guessed, lang_label AS matched_titlewords, url, CAST(collected_on AS VARCHAR) AS date FROM paid "
    "UNION ALL SELECT 'examples' || source, source, source, 'Wien', 3500, (SELECT string_agg(lang_label, '|' ORDER BY first) FROM (SELECT lang_label, min(doc_id) AS first FROM postings q WHERE q.source = p.source GROUP BY lang_label)), source, CAST(arg_min(collected_on, doc_id) AS VARCHAR) FROM postings p GROUP BY source",
    Q.salary_ctes("postings", "salary", "paid", factor="14")))
def s9(spark, sf):
    rows = payloads.parse_listing_json(_listing(spark, sf), SITE, F.lit(DAY))
    return as_text(rows.select(
        "posting_id", "title", "company", "locations", "salary_monthly_guessed", "matched_titlewords", "url", "date"
    ))


@query("s10_parse_detail_json", over_postings(
    "SELECT 'example' || CAST(doc_id AS VARCHAR) AS posting_id, md5(title || description) AS description_md5 FROM postings"))
def s10(spark, sf):
    escaped = F.replace(F.replace(F.replace("description", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<h1>"), "title", F.lit("</h1><script>var x = 1;</script><p>"), escaped, F.lit("</p><!-- end -->"))
    body = F.to_json(F.struct(F.struct(F.struct(
        F.struct(html.alias("text")).alias("jobContent"),
        F.struct(F.struct(F.col("doc_id").alias("id")).alias("job")).alias("jobHeader"),
    ).alias("jobDetailContent")).alias("data")))
    rows = payloads.parse_detail_json(postings(spark, sf).select(body.alias("body")), SITE)
    return rows.select("posting_id", F.md5("description").alias("description_md5"))


@query("s11_parse_listing_html", over_postings(
    "SELECT 'example' || CAST(doc_id AS VARCHAR) AS posting_id, title, 'https://jobs.example.org/job/x/' || CAST(doc_id AS VARCHAR) || '/' AS url, lang_label AS matched_titlewords FROM postings "
    "UNION ALL SELECT 'example9' || substr(source, 4) || '000000', source, 'https://jobs.example.org/job/s/9' || substr(source, 4) || '000000/', "
    "(SELECT string_agg(lang_label, '|' ORDER BY first) FROM (SELECT lang_label, min(doc_id) AS first FROM postings q WHERE q.source = p.source GROUP BY lang_label)) FROM postings p GROUP BY source"))
def s11(spark, sf):
    """A result page per posting; its source's own link repeats on very many pages."""
    html = F.concat(
        F.lit('<div><a class="other" href="/x/1/">skip</a><h2><a class="jobTitle-link big" href="/job/x/'), F.col("doc_id").cast("string"),
        F.lit('/"> <b>'), "title", F.lit('</b> </a></h2><a class="jobTitle-link" href="/job/s/9'), F.substring("source", 4, 10),
        F.lit('000000/">'), "source", F.lit("</a></div>"),
    )
    url = F.concat(F.lit(SITE.search_base_url), "lang_label", F.lit("&startrow=25"))
    pages = postings(spark, sf).select(html.alias("html"), url.alias("url"), F.col("doc_id").alias("seq"))
    rows = payloads.parse_listing_html(pages, SITE, "Example AG")
    return as_text(rows.select("posting_id", "title", "url", "matched_titlewords"))


@query("s12_parse_generic_html",
       "SELECT posting_id, arg_min(href, page_id * 1000 + i) AS href FROM (SELECT page_id, " + unescaped(
           "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2))"
       ) + " AS posting_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, "
       "unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>')))) AS i FROM pages) WHERE posting_id <> '' GROUP BY posting_id")
def s12(spark, sf):
    """Navigation links of all pages keyed by their text; the first occurrence wins."""
    pages = _pages(spark, sf).select("html", F.col("page_id").alias("seq"))
    rows = payloads.parse_generic_html(pages, "nav li a", title_attr="href")
    return rows.select("posting_id", F.col("title").alias("href"))


@query("p16_detail_html", over_postings(
    "SELECT posting_id, title AS role, company AS requirements, 'EUR 3,500.00 monthly gross' AS benefits, CAST(42000 AS BIGINT) AS annual, CAST(3500 AS BIGINT) AS monthly FROM postings"))
def p16_detail(spark, sf):
    html = F.concat(
        F.lit('<div class="joblayouttoken rtltextaligneligible displayDTM">intro</div>'
              '<div class="joblayouttoken x displayDTM rtltextaligneligible"><ul><li>'), "title",
        F.lit('</li></ul><ul class="skip"><li>no</li></ul><ul><li>'), "company",
        F.lit("</li></ul><ul><li>EUR 3,500.00 monthly gross</li></ul></div>"),
    )
    rows = payloads.parse_detail_html(postings(spark, sf).select("posting_id", html.alias("html")))
    return rows.select(
        "posting_id", "role", "requirements", "benefits",
        F.col("salary_guessed.annual").alias("annual"), F.col("salary_guessed.monthly").alias("monthly"),
    )
