"""Postings from raw payloads kept in bronze tables: listing/detail JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import SourceConfig
from postingflow.functions.columns import (
    clean_text, id_from_url, query_from_url, strip, trailing_id_from_url,
)
from postingflow.functions.html import html_to_text, is_full_page, page_links, page_sections
from postingflow.functions.salary import NumberFormat, with_salary_from_text, with_salary_dual_locale
from postingflow.operators.enrich import split_sections
from postingflow.operators.snapshots import dedupe_queries, first_per_key

LISTING_SCHEMA = (
    "data struct<jobsSearchList:struct<activeItems:struct<items:array<struct<"
    "jobsItem:struct<id:string,title:string,company:struct<name:string>,"
    "locations:array<struct<name:string>>,salary:string,isActive:boolean,isHomeOffice:boolean,"
    "employmentTypes:array<string>,link:string,snippet:string,date:string>>>>>>"
)
DETAIL_SCHEMA = (
    "data struct<jobDetailContent:struct<jobContent:struct<text:string>,"
    "jobHeader:struct<job:struct<id:string>>>>"
)


def listing_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per posting of listing JSON; advertisements between them are skipped."""
    rest = [c for c in pages.columns if c != body]
    items = pages.withColumn(
        "_items", F.from_json(body, LISTING_SCHEMA)["data"]["jobsSearchList"]["activeItems"]["items"]
    )
    return (
        items.select(*rest, F.posexplode_outer("_items").alias("item_pos", "_item"))
        .where(F.col("_item.jobsItem").isNotNull())
        .select(*rest, "item_pos", "_item.jobsItem.*")
    )


def parse_listing_json(
    pages: DataFrame, site: SourceConfig, collected_on: Column, body: str = "body", word: str = "query",
    order: str = "seq",
) -> DataFrame:
    """Postings of listing JSON, one row per posting over all pages and queries."""
    items = listing_items(pages, body)
    postings = items.select(
        F.concat(F.lit(site.name), F.col("id")).alias("posting_id"),
        "title", F.col("company.name").alias("company"),
        F.transform("locations", lambda x: x["name"]).alias("locations"),
        "salary", "isActive", "isHomeOffice", "employmentTypes", F.col("link").alias("url"),
        "snippet", "date", "id", F.lit(site.name).alias("source"),
        collected_on.alias("collected_on"),
        F.col(word).alias("_word"),
        F.struct(order, "item_pos").alias("_order"),
    )
    unique = dedupe_queries(postings, "_order", "_word").drop("_order")
    fmt = NumberFormat(site.thousands, site.decimal, site.salary_factor)
    read = with_salary_from_text(unique, F.col("salary"), "salary_guessed", fmt)
    return read.withColumn("salary_monthly_guessed", F.col("salary_guessed.monthly"))


def parse_detail_json(pages: DataFrame, site: SourceConfig, body: str = "body") -> DataFrame:
    """(posting_id, description) of detail JSON; empty details are left out."""
    content = F.from_json(body, DETAIL_SCHEMA)["data"]["jobDetailContent"]
    fields = pages.select(
        content["jobHeader"]["job"]["id"].alias("id"), content["jobContent"]["text"].alias("html")
    )
    return fields.where(F.col("id").isNotNull() & (F.col("html") != "")).select(
        F.concat(F.lit(site.name), F.col("id")).alias("posting_id"),
        html_to_text(F.col("html")).alias("description"),
    )


def listing_links(pages: DataFrame, selector: str, html: str = "html") -> DataFrame:
    """One row per matching link of listing pages."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(
        *rest, F.posexplode_outer(page_links(F.col(html), selector)).alias("link_pos", "_link")
    ).where(F.col("link_pos").isNotNull()).select(*rest, "link_pos", "_link.text", "_link.href", "_link.attrs")


def parse_listing_html(
    pages: DataFrame, site: SourceConfig, company: str, html: str = "html", url: str = "url",
    order: str = "seq",
) -> DataFrame:
    """Postings of listing HTML; the first occurrence of an id wins, and every search
    word that found it is kept."""
    links = listing_links(pages, site.link_selector, html)
    absolute = F.concat(F.lit(site.jobs_base_url), F.col("href"))
    postings = links.select(
        F.col("text"), absolute.alias("_url"),
        query_from_url(F.col(url), site.search_base_url).alias("_word"),
        F.struct(order, "link_pos").alias("_order"),
    ).withColumn("_id", trailing_id_from_url(F.col("_url"))).where(F.col("_id").isNotNull())
    rows = postings.select(
        F.concat(F.lit(site.name), F.col("_id")).alias("posting_id"),
        strip(F.col("text")).alias("title"),
        F.col("_url").alias("url"), F.lit(company).alias("company"), F.lit(site.name).alias("source"),
        F.concat(F.lit(site.name), F.col("_id")).alias("id"),
        "_word", "_order",
    )
    return dedupe_queries(rows, "_order", "_word").drop("_order")


def parse_generic_html(
    pages: DataFrame, selector: str, site: str = "", with_id: bool = False, id_attr: str | None = None,
    title_attr: str | None = None, company_attr: str | None = None, salary_attr: str | None = None,
    html: str = "html", order: str = "seq",
) -> DataFrame:
    """Postings of any listing HTML, keyed by id or by trimmed text; first one wins."""
    links = listing_links(pages, selector, html)
    text = strip(F.col("text"))

    def attr(name):
        return F.try_element_at("attrs", F.lit(name)) if name else F.lit(None).cast("string")

    found = id_from_url(attr(id_attr) if id_attr else F.col("text"))
    rows = links.select(
        (found if with_id else text).alias("posting_id"),
        attr(title_attr).alias("title"), attr(company_attr).alias("company"),
        (found if with_id else F.lit(None).cast("string")).alias("id"),
        F.lit(site).alias("source"), attr(salary_attr).alias("salary"), text.alias("text"),
        F.struct(order, "link_pos").alias("_order"),
    ).where(F.col("posting_id") != "")
    unique = first_per_key(rows, "_order").drop("_order")
    return with_salary_from_text(unique, F.col("salary"), "salary_versions")


def parse_detail_html(
    pages: DataFrame, block: str = config.SECTION_BLOCK_SELECTOR, html: str = "html",
    salary_factor: int = 12,
) -> DataFrame:
    """Role, requirements, benefits, salary and description of posting pages."""
    rest = [c for c in pages.columns if c != html]
    read = pages.select(*rest, page_sections(F.col(html), block).alias("_page")).where("_page.found")
    split = split_sections(
        read.select(*rest, F.col("_page.sections").alias("sections"), F.col("_page.text").alias("description"))
    )
    paid = with_salary_dual_locale(split, F.col("benefits"), "salary_guessed", salary_factor)
    cleaned = {c: clean_text(F.col(c)) for c in ("role", "requirements", "nice_to_have", "benefits", "description")}
    return paid.withColumns(
        {**cleaned, "salary_monthly_guessed": F.col("salary_guessed.monthly")}
    ).drop("sections")


def page_completeness(pages: DataFrame, selector: str, html: str = "html", sizes=config.FULL_PAGE_SIZES) -> DataFrame:
    """Links per page, and whether the page is full."""
    rest = [c for c in pages.columns if c != html]
    links = pages.select(*rest, page_links(F.col(html), selector).alias("_links"))
    return links.select(*rest, F.size("_links").alias("links"), is_full_page(F.col("_links"), sizes).alias("is_full"))
