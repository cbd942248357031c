"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_RAW = "struct<original_url:string,alt_text:string,title:string,caption:string,width:string,height:string>"
IMAGE = "struct<original_url:string,alt_text:string,title:string,caption:string,width:int,height:int>"
LINK = "struct<url:string,text:string,title:string,type:string>"
PLAIN_LINK = "struct<url:string,text:string,title:string>"
VALIDATION = "struct<issues_found:int,issues:array<string>>"

RAW_PAGES = "url string, html string"

_POST = (
    "pos int, url string, id string, slug string, title string, meta_description string, author string, content_html string, content_text string, "
    "content_markdown string, excerpt string, word_count {count}, published_date string, modified_date string, scraped_at string, extracted_at string, "
    "categories array<string>, tags array<string>, images array<{image}>, links array<{link}>"
)
#: Posts as extracted: counts and sizes may still be bad strings.
FLAT_POSTS = _POST.format(count="string", image=IMAGE_RAW, link=LINK)
#: Posts after validation.
VALIDATED_POSTS = _POST.format(count="int", image=IMAGE, link=LINK) + f", validation {VALIDATION}"
#: The nested record of the archive.
ARCHIVED_POSTS = (
    "id string, title string, slug string, url string, published_date string, modified_date string, author string, excerpt string, "
    "content struct<html:string,text:string,markdown:string,word_count:int>, metadata struct<categories:array<string>,tags:array<string>,meta_description:string>, "
    "assets struct<images:array<struct<original_url:string,local_path:string,alt_text:string,caption:string,title:string,dimensions:struct<width:int,height:int>>>,"
    f"links:struct<internal:array<{PLAIN_LINK}>,external:array<{PLAIN_LINK}>,email:array<{PLAIN_LINK}>,phone:array<{PLAIN_LINK}>>>, "
    f"archive_info struct<scraped_at:string,extracted_at:string,validation_info:{VALIDATION}>"
)
HISTORICAL_POSTS = (
    "url string, scraped_at string, id string, slug string, title string, content string, content_length int, word_count int, published_date string, "
    "year int, month int, author string, extraction_method string"
)
SESSION_EVENTS = "session_id string, url string, status string, error string, ts timestamp, seconds double, html_len long, n_images int"
UPDATE_LOG = "timestamp string, successful_updates long, total_requested_updates long"
UPDATED_URLS = "timestamp string, url string, status string"
PHASES = "session_id string, phase string, ts timestamp"
IMAGE_LEDGER = "original_url string, local_path string, status string, bytes long"


def parsed(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
